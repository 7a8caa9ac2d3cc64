"""Exact, similar, line and byte-string duplicates."""

import collections
import random
import re
import tracemalloc

import numpy as np
import plain
import pyarrow as pa
import pytest

from hoplens.llm import exact_dedup, jaccard_join, line_dedup, suffix_dedup, words
from hoplens.llm.components import components
from pyspark.sql import functions as F


def stored(docs, tmp_path):
    path = str(tmp_path / "docs.parquet")
    docs.write.parquet(path)
    return path


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda text: F.length(text).cast("string")])
@pytest.mark.parametrize("few_hits", [0, 1000])
def test_exact_groups(spark, documents, odd, tmp_path, digest, few_hits):
    rows = [*odd, *((i, f"Text {i % 7}") for i in range(20, 60)), (90, "ÄÖ"), (91, "äö")]
    path = stored(documents(rows), tmp_path)
    found = exact_dedup.dedupe_table(spark, path, digest=digest, files=2, few_hits=few_hits).collect()
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[lower(text)].append(doc_id)
    last = {text: max((i for i in ids if i is not None), default=None) for text, ids in groups.items()}
    want = sorted((str(i), str(last[lower(t)]), len(groups[lower(t)]), plain.sha(lower(t))) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in found) == want
    assert sum(r.kept for r in found) == len(groups)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_state_goes_on(spark, documents, tmp_path):
    """A second call reads what is new alone and keeps what it knew."""
    path, checkpoint = str(tmp_path / "docs.parquet"), str(tmp_path / "state")
    documents([(1, "a"), (2, "b")]).write.parquet(path)
    exact_dedup.dedupe_table(spark, path, checkpoint).count()
    documents([(3, "A")]).write.mode("append").parquet(path)
    found = exact_dedup.dedupe_table(spark, path, checkpoint).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in found) == [(1, 3, 2), (2, 2, 1), (3, 3, 2)]


def test_unique_rows(documents, odd):
    docs = documents(odd)
    kept = exact_dedup.unique_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["2", "3", "4", "5", "6", "7"]
    assert exact_dedup.unique_rows(docs.where(F.lit(False))).count() == 0


def similar_texts(seed):
    random.seed(seed)
    texts = []
    for _ in range(70):
        size = random.choice([0, 1, 2, 3, 5, 11, 12, 13, 14, 25, 40, 80, 150, 400])
        base = [random.choice("abcdefghijklmnopqrstuvwxyz") + str(random.randrange(30)) for _ in range(size)]
        texts.append(" ".join(base))
        for _ in range(random.choice([0, 0, 1, 3, 8])):
            copy = list(base)
            for _ in range(random.randrange(0, max(1, size // 30) + 1) if copy else 0):
                copy[random.randrange(len(copy))] = f"Z{random.randrange(100)}"
            if random.random() < 0.3 and copy:
                copy = copy[: -random.randrange(1, max(2, size // 20))]
            texts.append(" ".join(copy).upper() if random.random() < 0.3 else "\t".join(copy))
    for _ in range(100):  # one large group of near copies
        copy = [f"q{i}" for i in range(200)]
        for _ in range(random.randrange(0, 5)):
            copy[random.randrange(200)] = f"y{random.randrange(1000)}"
        texts.append(" ".join(copy))
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("size, p, q, entries, few", [(3, 9, 10, 4_000_000, 10**6), (3, 9, 10, 3000, 0), (5, 4, 5, 3000, 10**6), (1, 1, 2, 5000, 0)])
def test_similar_groups(documents, odd, size, p, q, entries, few):
    rows = [*odd, *similar_texts(size)]
    found = jaccard_join.similar_groups(documents(rows), size, (p, q), entries, few).collect()
    assert collections.Counter((r.doc_id, r.n, r.component_id) for r in found) == plain.similar_groups(rows, size, p, q)


@pytest.mark.parametrize("similar", [(1, 4), (1, 2), (3, 5), (2, 3), (4, 5), (9, 10)])
def test_similar_sets_share_a_key(similar):
    p, q = similar
    entries = np.arange(1, 120, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for size in range(1, 120):
            whole = jaccard_join.signatures(entries[:size], similar)
            assert len(set(whole.tolist())) == len(whole)
            for least in range(-(-size * p // q), size + 1):  # the other has the last entries only
                assert np.isin(jaccard_join.signatures(entries[size - least : size], similar), whole).any()


@pytest.mark.parametrize("similar", [(1, 4), (1, 2), (2, 3), (4, 5), (9, 10)])
def test_similar_sets_share_many_keys(spark, similar):
    p, q = similar
    rng = random.Random(5)
    sets, names = [], []
    with np.errstate(over="ignore"):
        for _ in range(60):
            common, left, right = (rng.randrange(1, most) for most in (150, 12, 12))
            entries = np.array(rng.sample(range(10**6), common + left + right), np.uint64)
            pair = np.sort(entries[: common + left]), np.sort(np.concatenate([entries[:common], entries[common + left :]]))
            if q * common >= p * (common + left + right):
                names.append((len(sets), len(sets) + 1))
            sets += pair
        keys = [(int(k), a, len(own)) for a, own in enumerate(sets) for k in jaccard_join.signatures(own, similar).view(np.int64)]
    rows = spark.createDataFrame(keys, "key long, a long, n int")
    assert len(names) > 5
    assert set(names) <= {(r.a, r.b) for r in jaccard_join._pairs(rows, similar).collect()}


def test_sets_with_a_key_or_two_are_no_pair(spark):
    rows = [(key, a, 480) for a in range(10) for key in (1, 2, 100 + a)]
    rows += [(key, a, 480) for a in (20, 21) for key in range(1000, 1023)]  # 24 are needed
    rows += [(key, a, n) for a, n in ((30, 480), (31, 480)) for key in range(2000, 2024)]
    rows += [(key, a, n) for a, n in ((40, 400), (41, 480)) for key in range(3000, 3040)]  # sizes too far apart
    frame = spark.createDataFrame(rows, "key long, a long, n int")
    assert {(r.a, r.b) for r in jaccard_join._pairs(frame, (9, 10)).collect()} == {(30, 31)}


def test_keys_are_made_once(spark, documents):
    docs = documents([(1, "one two three four")])
    once = spark.createDataFrame([], jaccard_join._read_once(docs, 3).schema)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = jaccard_join._candidates(docs, once, 3, (9, 10))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(re.findall(r"MapInArrow read\(text#", plan)) == 1


@pytest.mark.parametrize("p, q", [(1, 2), (3, 5)])
def test_pairs_of_far_sizes(documents, p, q):
    rows = []
    for size in (4, 6, 13, 19, 30, 50, 90):
        for least in range(-(-size * p // q) - 1, size):  # own words, so that a pair is a component
            name = f"s{size}x{least}w"
            rows += [(len(rows), " ".join(f"{name}{i}" for i in range(size))), (len(rows) + 1, " ".join(f"{name}{i}" for i in range(least)))]
    found = jaccard_join.similar_groups(documents(rows), 1, (p, q)).collect()
    assert collections.Counter((r.doc_id, r.n, r.component_id) for r in found) == plain.similar_groups(rows, 1, p, q)


def _peak(run):
    """Bytes that a call holds at most, beside what was held before."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_words_of_texts_are_not_held_together():
    texts = [b" ".join(b"word%05d" % (i * j % 1000) for j in range(100)) for i in range(2000)]
    words.word_hashes(texts, words.LOWER)
    assert _peak(lambda: words.word_hashes(texts, words.LOWER)) < 3 * sum(map(len, texts))


def test_few_known_words_are_held():
    texts = [b" ".join(b"word%d" % (i * 100 + j) for j in range(100)) for i in range(2000)]
    words._known.clear()
    assert _peak(lambda: words.word_hashes(texts, words.LOWER)) < 15 << 20
    assert len(words._known) <= 50_000
    words._known.clear()


def test_a_task_gathers_few_texts():
    batch = pa.record_batch({"text": ["x" * (1 << 20)] * 40})
    sizes = [sum(len(text) for texts in held for text in texts) for held in words.gathered([batch])]
    assert sum(sizes) == 40 << 20 and max(sizes) <= 12 << 20


def test_a_part_with_itself_is_held_once():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 1 << 63, 3000)
    sets = [np.unique(np.concatenate([shared[i % 7 :], rng.integers(0, 1 << 63, 200)])).astype(np.uint64) for i in range(100)]
    edges = []
    peak = _peak(lambda: edges.extend(jaccard_join.product_edges(sets, None, (4, 5))))
    assert len(edges) == 99
    assert peak < 10 * sum(x.nbytes for x in sets)


@pytest.mark.parametrize("similar", [(1, 2), (9, 10)])
def test_products_equal_plain_overlaps(monkeypatch, similar):
    monkeypatch.setattr(jaccard_join, "DENSE_COLUMNS", 7)
    monkeypatch.setattr(jaccard_join, "DENSE_ROWS", 5)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40))).astype(np.uint64) for _ in range(40)] + [np.array([99], np.uint64)]
    alike = lambda a, b: similar[1] * len({*a} & {*b}) >= similar[0] * len({*a} | {*b})
    for left, right in ((sets, None), (sets[:25], sets[25:]), (sets, sets[:1]), (sets[-1:], sets[:1])):
        found = list(jaccard_join.product_edges(left, right, similar))
        other = left if right is None else right
        assert all(alike(left[i], other[j]) for i, j in found)
        # Names of both sides' rows, as one part's are the same rows.
        name = lambda j: j if right is None else len(left) + j
        wanted = {(i, name(j)) for i, a in enumerate(left) for j, b in enumerate(other) if alike(a, b) and i != name(j)}
        assert _joined_rows((i, name(j)) for i, j in found) == _joined_rows(wanted)


def _joined_rows(edges):
    """What edges connect."""
    groups = {}
    for a, b in edges:
        both = groups.get(a, {a}) | groups.get(b, {b})
        groups |= dict.fromkeys(both, both)
    return groups


def test_one_of_each(documents, odd):
    rows = [*odd, *similar_texts(3)]
    docs = documents(rows)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = plain.similar_groups(rows, 3, 9, 10)
    want = {component for _, n, component in groups if n} | {i for i, n, _ in groups if not n}
    assert {r.doc_id for r in kept.collect()} == want
    assert jaccard_join.one_of_each(docs.where(F.lit(False))).count() == 0


def test_components(spark):
    random.seed(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(300, 300)]
    edges += [(random.randrange(400, 500), random.randrange(400, 500)) for _ in range(60)]
    random.shuffle(edges)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for edge in edges for x in edge}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[top(a)] = top(b)
    nodes = [x for x in parent if x != 300]
    assert set(found) >= {x for x in nodes if sum(top(x) == top(y) for y in nodes) > 1}
    assert len({(found[x], top(x)) for x in found}) == len({found[x] for x in found}) == len({top(x) for x in found})


def line_texts(seed):
    random.seed(seed)
    lines = [" ".join(random.choice("abcdefgh") for _ in range(random.choice([1, 3, 6, 12]))) for _ in range(25)]
    base = [random.choice(lines) for _ in range(12)]
    rows = []
    for i in range(60):
        at = random.randrange(len(base))
        own = [random.choice(lines) for _ in range(random.randint(0, 6))] + base[at : at + random.randint(0, 6)]
        rows.append((i, "\n".join(own + [random.choice(["", "  ", *lines]) for _ in range(3)])))
    return rows + [(3, rows[3][1]), (None, rows[5][1]), (77, None), (78, ""), (79, "a b c\n" * 3000)]


@pytest.mark.parametrize("window", [1, 2])
def test_repeated_runs(documents, window):
    rows = line_texts(window)
    docs = documents(rows)
    want = plain.repeated_lines([row for row in rows if row[0] != 79], 10)
    found = collections.defaultdict(set)
    for r in line_dedup.repeated_runs(docs, 10, window).where("doc_id IS NULL OR doc_id < 79").collect():
        for row in want:
            if row[0] == r.doc_id and row[1]:
                found[row] |= {i for i in range(r.first_line, r.last_line + 1) if row[1].split("\n")[i].strip()}
    assert {row: gone for row, gone in want.items() if gone} == dict(found)


def test_drop_repeats(documents):
    passage = "\n".join(" ".join(f"w{i}{j}" for j in range(20)) for i in range(4))
    docs = documents([(1, f"first\n{passage}\nend"), (2, f"other\n{passage}"), (3, "a short line\n"), (4, "a short line\n"), (5, None)])
    kept = line_dedup.drop_repeats(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {
        1: f"first\n{passage}\nend", 2: "other", 3: "a short line\n", 4: "a short line\n", 5: None,
    }
    assert line_dedup.repeated_runs(docs.where(F.lit(False))).count() == 0


def byte_texts():
    random.seed(2)

    def text(size, signs="abcdefgh "):
        return "".join(random.choice(signs) for _ in range(size))

    texts = ["a" * 700, "ab" * 400, "a" * 199, "a" * 200, text(37) * 20, text(1000), "é" * 300, "é" * 90 + "x"]
    for _ in range(6):
        base = text(random.randint(150, 1500))
        texts += [base, text(100) + base[: random.randint(100, len(base))] + text(77), base[random.randint(0, 50) :] + base[:300]]
        for _ in range(random.randint(0, 5)):
            copy = list(base)
            for _ in range(random.randint(0, 4)):
                copy[random.randrange(len(copy))] = random.choice("xyz")
            texts.append("".join(copy))
    for phrase in (text(150), text(260)):
        texts += [text(random.randint(0, 300)) + phrase + text(300) for _ in range(20)]
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("hot, sort_bytes", [(20_000, 1 << 20), (3, 5000)])
def test_remove_repeats(documents, odd, monkeypatch, hot, sort_bytes):
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", sort_bytes)
    rows = [*[row for row in odd if row[0] not in (5, 6)], *byte_texts(), (140, "q" * 300), (140, "q" * 300)]
    kept = plain.without_repeats([(text or "").encode() for _, text in rows], 200)
    found = suffix_dedup.remove_repeats(documents(rows), hot=hot).collect()
    want = collections.Counter((i, len((text or "").encode()), own) for (i, text), own in zip(rows, kept, strict=True))
    assert collections.Counter((r.doc_id, r.n_bytes, bytes(r.kept)) for r in found) == want
    assert all(r.n_bytes - len(r.kept) == sum(s["end"] - s["start"] for s in r.spans) for r in found)


def test_long_periodic_texts(documents):
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(documents([(1, "x" * 100_000), (2, "é " * 50_000), (3, None)])).collect()}
    assert found[1].kept == b"" and found[2].kept == b"" and found[3].n_bytes == 0


def test_tiles_of_a_long_text(monkeypatch):
    rng = np.random.default_rng(1)
    text = rng.integers(97, 101, 5000).astype(np.uint8)
    whole = suffix_dedup.anchors(text, 200)
    monkeypatch.setattr(suffix_dedup, "TILE", 700)
    cut = suffix_dedup.anchors(text, 200)
    spread = lambda found: [(g, p) for g, a, b, p in zip(*found, strict=True) for _ in range(a, b + 1)]
    assert spread(whole) == spread(cut)


def test_cover():
    reached = {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER}
    assert reached == set(range(suffix_dedup.PERIOD))


def test_no_repeats_in_an_empty_table(documents):
    assert suffix_dedup.remove_repeats(documents([(1, "a")]).where(F.lit(False))).count() == 0


def test_places_of_one_string_are_spread(documents, monkeypatch):
    """A third of all rows are equal, in one partition: no bucket gets all their places, and no row very many."""
    monkeypatch.setattr(suffix_dedup, "PLACES", 50)
    random.seed(4)
    word = lambda: "".join(random.choices("abcdefgh", k=8))
    copy = " ".join(word() for _ in range(60))
    texts = [copy] * 1000 + [" ".join(word() for _ in range(40)) for _ in range(2000)]
    seen = {}
    real = suffix_dedup._sorted
    monkeypatch.setattr(suffix_dedup, "_sorted", lambda stretches, length: real(seen.setdefault("stretches", stretches), length))
    found = suffix_dedup.remove_repeats(documents(list(enumerate(texts)), parts=1)).collect()
    wanted = dict(enumerate(plain.without_repeats([text.encode() for text in texts], 200)))
    assert {row.doc_id: bytes(row.kept) for row in found} == wanted
    rows = seen["stretches"].selectExpr("bucket", "length(places) / 20 AS places").collect()
    assert max(row.places for row in rows) <= 50
    per_bucket = {}
    for row in rows:
        per_bucket[row.bucket] = per_bucket.get(row.bucket, 0) + row.places
    assert sum(per_bucket.values()) >= 1000 and max(per_bucket.values()) <= 50


def test_extension_ends_where_lines_differ():
    line = lambda n: n.to_bytes(16, "little")
    own = b"".join(map(line, [1, 2, 3, 4, 5, 6, 7, 8]))
    there = b"".join(map(line, [9, 9, 2, 3, 4, 5, 0, 7, 8, 1]))
    assert line_dedup.extended(own, there, 1, [(2, 3)]) == [(1, 4)]
    assert line_dedup.extended(own, there, 1, [(2, 3), (1, 2), (6, 7)]) == [(1, 4), (6, 7)]
    assert line_dedup.extended(own, own, 0, [(0, 0)]) == [(0, 7)]
    assert line_dedup.extended(own, there, 1, [(3, 5)]) == []
    periodic = line(1) * 10
    assert line_dedup.extended(periodic, periodic, -3, [(4, 5)]) == [(3, 9)]


@pytest.mark.parametrize("length", [60, 5000])
def test_matches_are_extended_both_ways(documents, length):
    """Long runs that other texts hold parts of, one line changed in the middle: whatever seed meets whichever place, whole runs go."""
    lines = [f"line {i} of a long run" for i in range(length)]
    changed = [*lines[: length // 2], "another line stands here", *lines[length // 2 + 1 :]]
    rows = [
        (1, "\n".join(lines[10:30])), (2, "\n".join(["own first", *lines, "own last"])), (3, "\n".join(["x", *lines, "y"])),
        (4, "\n".join(["p", "q", *changed])), (5, "\n".join(lines[20:28])),
    ]
    found = {}
    for row in line_dedup.repeated_runs(documents(rows)).orderBy("first_line").collect():
        found.setdefault(row.doc_id, []).append((row.first_line, row.last_line))
    half = length // 2
    assert found == {2: [(11, 30)], 3: [(1, length)], 4: [(2, half + 1), (half + 3, length + 1)]}
