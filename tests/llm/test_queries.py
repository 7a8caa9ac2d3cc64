"""Registered queries and the pipeline over whole tables."""

import collections
import hashlib

import check
import corpus_pipeline
import plain
import pytest

from hoplens.llm import decontaminate, queries
from hoplens.llm.words import LETTERS

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def run(spark, name):
    return queries.QUERIES[name](spark, SF_DIR).collect()


def test_one_query_for_each_operator():
    assert [int(name[2:].split("_")[0]) for name in queries.QUERIES] == list(range(1, 14))


@pytest.mark.parametrize("name", queries.SQL)
def test_sql(spark, name):
    assert check.difference(spark, check.connect(SF_DIR), queries.QUERIES[name], queries.SQL[name], SF_DIR) is None


def test_op1(spark, rows):
    kept = dict(zip(rows, plain.without_repeats([t.encode() for t in rows.values()], 200), strict=True))
    for r in run(spark, "op1_suffix_dedup"):
        assert r.kept_sha256 == hashlib.sha256(kept[r.doc_id]).hexdigest()
        assert r.n_removed == r.n_bytes - len(kept[r.doc_id])


@pytest.mark.parametrize("name, search", [("op3_secret_scan", plain.secrets), ("op5_pii", plain.pii)])
def test_spans(spark, rows, name, search):
    found = run(spark, name)
    assert len(found) == len(rows)
    for r in found:
        spans = search(rows[r.doc_id])
        assert r.base_sha256 == plain.sha(plain.joined(spans))
        counts = collections.Counter(kind for *_, kind in spans)
        assert all(r[f"n_{kind}"] == counts[kind] for kind in {kind for *_, kind in spans})


def test_op4(spark, rows):
    found = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in run(spark, "op4_jaccard_join"))
    assert found == plain.similar_groups(list(rows.items()), 3, 9, 10)


def test_op7(spark, rows):
    want = {i: gone for (i, _), gone in plain.repeated_lines(list(rows.items()), 50).items() if gone}
    found = collections.defaultdict(set)
    for r in run(spark, "op7_line_dedup"):
        lines = rows[r.doc_id].split("\n")
        found[r.doc_id] |= {i for i in range(r.first_line, r.last_line + 1) if lines[i].strip()}
    assert dict(found) == want


def test_op10(spark, rows):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id) for r in run(spark, "op10_decontaminate")}
    whole = {(i, k) for i, text in rows.items() for k, item in items.items() if len(item.split()) >= 5 and item in text}
    assert whole <= found
    words = lambda text: text.encode().translate(LETTERS).split()
    grams = lambda own: {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
    docs, tests = {i: words(text) for i, text in rows.items()}, {k: words(text) for k, text in items.items()}
    seeds = {k: grams(own) for k, own in tests.items()}
    exact = set()
    for i, own in docs.items():
        held = grams(own)
        for k, item in tests.items():
            # Only what seeds reach can be tiled.
            if held & seeds[k] and plain.tiled_words(item, near(own, seeds[k]), 5) >= 0.8 * len(item):
                exact.add((i, k))
    assert found == exact


def near(own, seeds):
    """A text's words around seeds; others become words that nothing equals."""
    kept = [None] * len(own)
    for i in range(len(own) - 4):
        if tuple(own[i : i + 5]) in seeds:
            kept[i : i + 5] = own[i : i + 5]
    return [(i,) if word is None else word for i, word in enumerate(kept) if word is not None or (i and kept[i - 1] is not None)]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six seven eight"), (2, None)], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    return str(tmp_path)


def through_all(spark, docs, folder):
    """What each stage of the pipeline keeps, written and read as the pipeline does."""
    kept = []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{number}")
        after = spark.read.parquet(f"{folder}/{number}")
        if name != "packing":
            assert after.dtypes == docs.dtypes
        kept.append(after.collect())
        docs = after
    return kept


def test_pipeline_of_odd_rows(spark, frame, odd, folder):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [*odd, (8, long), (9, f"{long} end"), (10, "ONE two, three four five six! seven eight"), (None, None), (11, "½ 12")]
    docs = frame([(i, text, "en" if i else None, f"s{n % 3}" if n % 4 else None) for n, (i, text) in enumerate(rows)])
    *stages, packed = through_all(spark, docs, folder)
    texts = [[row.text for row in stage] for stage in stages]
    lettered = [text for _, text in rows if text and any(c.isalpha() for c in text)]
    assert sorted(texts[0]) == sorted(lettered)
    assert sorted(map(str.lower, texts[1])) == sorted({text.lower() for text in lettered})
    # 8 and 9 are near copies; 10 holds the benchmark's item in other signs.
    assert {row.doc_id for row in stages[2]} >= {5, 6, 8, 10} and 9 not in {row.doc_id for row in stages[2]}
    assert {row.doc_id for row in stages[3]} == {row.doc_id for row in stages[2]} - {10}
    assert {row.doc_id for row in packed} == {row.doc_id for row in stages[3]}


def test_pipeline_of_an_empty_table(spark, frame, folder):
    assert through_all(spark, frame([(1, "a", "en", "s")]).where("doc_id = 0"), folder) == [[]] * 5


def test_pipeline(spark, rows):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "decontaminate", "packing"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = set(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, SF_DIR)
        assert result.schema == docs.schema
        ids = [r.doc_id for r in result.select("doc_id").collect()]
        assert len(ids) == len(set(ids))
        before, kept = kept, set(ids)
        if name == "language":
            assert kept == {i for i in before if any(c.isalpha() for c in rows[i])}
        if name == "exact_dedup":
            last = {}
            for i in sorted(before):
                last["".join(c.lower() if "A" <= c <= "Z" else c for c in rows[i])] = i
            assert kept == set(last.values())
        if name == "near_dedup":
            assert kept == {c for _, n, c in plain.similar_groups([(i, rows[i]) for i in before], 5, 4, 5)}
        if name == "decontaminate":
            pairs = decontaminate.contaminated(docs, spark.read.parquet(f"{SF_DIR}/benchmark.parquet"))
            assert kept == before - {r.doc_id for r in pairs.collect()}
        docs = result
    packed = corpus_pipeline.run(spark, SF_DIR)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept
