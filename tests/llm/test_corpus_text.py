"""Packing, decontamination and language."""

import collections
import json
import random
import zlib

import corpus_pipeline
import numpy as np
import plain
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hoplens.llm import decontaminate, language, packing, queries, words
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_pieces_hold_the_tokens(documents, odd, tokenizer):
    rows = [*[r for r in odd if r[0] != 6], (30, "<|endoftext|> it's  two\n\n spaces"), (31, "word " * 500), (32, "a" * 3000)]
    found = packing.pack(documents(rows), 64, RANKS, public_tokenizers.PATTERN).collect()
    want = collections.Counter()
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, (start, length) in enumerate(packing.pieces_of(len(ids), 64)):
            own = np.array(ids[start : start + length], "<u4")
            want[doc_id, piece, start, length, zlib.crc32(own.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    check_sequences(found, 64)


def test_added_tokens_in_texts(spark, documents, tmp_path, odd):
    mark = "<|endoftext|>"
    texts = [mark, f"end {mark} start", f"a  {mark}{mark}\n it's{mark}", f"{mark} " * 3000, "<|endoftext|", f"é{mark}😀 <|{mark}|>"]
    rows = [*[r for r in odd if r[0] != 6], *enumerate(texts, 40)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    named = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for doc_id, text in rows:
        ids = [*named.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, (start, length) in enumerate(packing.pieces_of(len(ids), 2048)):
            own = np.array(ids[start : start + length], "<u4")
            want[doc_id, piece, start, length, zlib.crc32(own.tobytes())] += 1
    packed = corpus_pipeline.packed(spark, documents(rows), str(tmp_path))
    for result in (queries.op8_packing(spark, str(tmp_path)), packed):
        found = result.collect()
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
        check_sequences(found, 2048)


def test_added_tokens_with_options(tmp_path):
    token = {"id": 9, "content": "<x>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    path = tmp_path / "vocabulary.json"
    path.write_text(json.dumps({"added_tokens": [token]}))
    assert packing.added_tokens(str(path)) == (("<x>", 9),)
    path.write_text(json.dumps({"added_tokens": [token | {"lstrip": True}]}))
    with pytest.raises(ValueError, match="<x>"):
        packing.added_tokens(str(path))


def check_sequences(found, capacity):
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_pieces_of():
    assert packing.pieces_of(1, 4) == [(0, 1)]
    assert packing.pieces_of(4, 4) == [(0, 4)]
    assert packing.pieces_of(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_equal_lengths_and_copies(documents):
    rows = [(i, "same words here") for i in range(500)]
    found = packing.pack(documents(rows), 64, RANKS, public_tokenizers.PATTERN).collect()
    assert check_sequences(found, 64) == -(-500 // (64 // found[0].length))


@pytest.mark.parametrize("capacity", [7, 100, 2048])
def test_plans(capacity):
    random.seed(capacity)
    for size in (0, 1, 2, 3, 50, 1000, 5000):
        for mean in (0.05, 0.3, 0.6):
            lengths = [min(capacity, max(1, int(capacity * random.lognormvariate(np.log(mean), 0.8)))) for _ in range(size)]
            bins = packing.plan_bins(collections.Counter(lengths), capacity)
            held = collections.Counter()
            for group in bins:
                assert group.number > 0 and group.room == capacity - sum(n * k for n, k in group.items) >= 0
                assert sum(k for n, k in group.items if 3 * n > capacity) <= 2
                for n, k in group.items:
                    held[n] += k * group.number
            assert held == collections.Counter(lengths)
            large = sum(2 * n > capacity for n in lengths)
            least = max(-(-sum(lengths) // capacity), large)
            assert sum(group.number for group in bins) <= 1.2 * least + 1
            assert len(bins) <= 5 * capacity


@pytest.mark.parametrize("capacity", [32_767, 32_768, 131_072])
def test_large_capacities(documents, capacity):
    text = "one two three four "
    rows = [(i, text * (capacity // 4 * (i % 5) // 4 + i)) for i in range(24)] + [(99, text * capacity), (100, None)]
    found = packing.pack(documents(rows), capacity, RANKS, public_tokenizers.PATTERN).collect()
    check_sequences(found, capacity)
    assert max(row.length for row in found) == capacity
    ids = {}
    for row in found:
        ids.setdefault(row.doc_id, []).append((row.piece, row.start, row.length))
    for i, text in rows:
        assert [(start, length) for _, start, length in sorted(ids[i])] == packing.pieces_of(len(packing._ids(text or "", RANKS, public_tokenizers.PATTERN, ())), capacity)


def test_capacities_that_cannot_be_planned_are_refused(documents):
    for capacity in (0, packing.MOST_CAPACITY + 1):
        with pytest.raises(ValueError):
            packing.pack(documents([(1, "a")]), capacity, RANKS, public_tokenizers.PATTERN)


def test_plans_of_very_many_lengths():
    """A plan for every length there is takes seconds."""
    capacity = 131_072
    counts = {length: 1 + length % 7 for length in range(1, capacity + 1, 3)}
    held = collections.Counter()
    for group in packing.plan_bins(counts, capacity):
        assert group.room == capacity - sum(n * k for n, k in group.items) >= 0
        for n, k in group.items:
            held[n] += k * group.number
    assert held == collections.Counter(counts)


def test_blocks_follow_the_number_of_pieces(documents, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 3)
    rows = [(i, "same words here " * (1 + i % 3)) for i in range(300)]
    found = packing.pack(documents(rows), 64, RANKS, public_tokenizers.PATTERN).collect()
    assert len(found) == 300 and check_sequences(found, 64) > 0


def test_packing_starts_no_second_pool_of_workers(documents, monkeypatch):
    rows = documents([(i, "same words here " * (1 + i % 3)) for i in range(30)])
    with monkeypatch.context() as patched:
        patched.setattr(type(rows.sparkSession), "createDataFrame", lambda *_: pytest.fail("rows of the driver"))
        found = packing.pack(rows, 64, RANKS, public_tokenizers.PATTERN)
    assert len(found.collect()) == 30


def test_no_documents(documents):
    none = documents([(1, "a")]).where(F.lit(False))
    assert packing.pack(none, 64, RANKS, public_tokenizers.PATTERN).count() == 0
    assert packing.plan_bins({}, 64) == []


def test_tiles_equal_plain_tiles():
    random.seed(1)
    differing = 0
    for _ in range(200):
        vocabulary = [b"w%d" % i for i in range(random.choice([3, 8, 40]))]
        item = [random.choice(vocabulary) for _ in range(random.randint(5, 40))]
        parts = [item[i : i + random.randint(3, 12)] for i in range(0, len(item), random.randint(4, 9))]
        random.shuffle(parts)
        doc = [random.choice(vocabulary) for _ in range(random.randint(0, 30))]
        for part in parts:
            doc += part + [random.choice(vocabulary)] * random.randint(0, 2)
        seeds = decontaminate.Seeds([(0, b" ".join(item))], 5)
        flat, _ = words.word_hashes([b" ".join(doc)], words.LETTERS)
        with np.errstate(over="ignore"):
            near = seeds.near(words.shingles(flat, 5))
        found = decontaminate.tiles(seeds.words[0], flat, near, 5) if len(near) else []
        for start, at, length in found:
            assert item[start : start + length] == doc[at : at + length] and length >= 5
        differing += sum(x[2] for x in found) != plain.tiled_words(item, doc, 5)
    assert differing <= 4  # equally long matches may be taken in another order


def benchmark(spark, texts):
    return spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "item_id long, text string").selectExpr("*", "'x' AS item")


def test_reordered_passages(spark, documents, odd, monkeypatch):
    item = [f"term{i}" for i in range(40)]
    turned = " ".join([*item[20:], "between", *item[:20]])
    rows = [
        *odd, (20, " ".join(item)), (21, turned.upper() + "!"), (22, " ".join(item[:30])), (23, " ".join(item[::-1])),
        (24, "x " * 30_000 + ", ".join(item)), (25, " ".join(item[:36])),
    ]
    texts = [" ".join(item), None, "", "too short", " ".join(item)]
    monkeypatch.setattr(decontaminate, "HELD_WORDS", 20)  # seeds are a table
    for found in (decontaminate.contaminated(documents(rows), benchmark(spark, texts)).collect(),):
        assert sorted((r.doc_id, r.item) for r in found) == sorted((d, i) for d in (20, 21, 24, 25) for i in (0, 4))
        assert {r.tiles for r in found if r.doc_id == 21} == {2}
    docs = documents(rows)
    clean = decontaminate.clean_rows(docs, benchmark(spark, texts))
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in rows if i not in (20, 21, 24, 25))


def test_seeds_as_a_table_give_the_same(spark, documents, monkeypatch):
    """A benchmark that is not sent to tasks: the same pairs, each document read for seeds once."""
    rng = random.Random(6)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(60))
    items = [" ".join(word() for _ in range(rng.randint(3, 40))) for _ in range(120)] + ["a b c d e"] * 2 + [None, "", "one two"]
    rows = []
    for i in range(150):
        parts = [" ".join(word() for _ in range(30))]
        for item in rng.sample(items[:120], rng.randrange(3)):
            own = item.split()
            cut = rng.randrange(len(own))
            parts += [" ".join(own[cut:]), " ".join(own[:cut])] if rng.random() < 0.7 else [" ".join(own[: len(own) // 2])]
        rows.append((i % 140, " ".join(parts) + (" A b, c d! e" if i % 9 == 0 else "")))
    rows += [(None, rows[0][1]), (500, None), (501, ""), rows[3], rows[3]]
    docs, table = documents(rows), benchmark(spark, items)
    found = {}
    for held in (2_000_000, 0):
        monkeypatch.setattr(decontaminate, "HELD_WORDS", held)
        pairs = decontaminate.contaminated(docs, table)
        found[held] = sorted(str(tuple(row)) for row in pairs.collect())
        clean = decontaminate.clean_rows(docs, table)
        assert clean.columns == docs.columns
        found[held, "clean"] = sorted(str(row.doc_id) for row in clean.collect())
    assert found[0] == found[2_000_000] and len(found[0]) > 100
    assert found[0, "clean"] == found[2_000_000, "clean"] and len(found[0, "clean"]) > 10


def test_empty_sides(spark, documents):
    docs = documents([(1, "a b c d e f")])
    assert decontaminate.contaminated(docs, benchmark(spark, ["a b c d e"]).where(F.lit(False))).count() == 0
    assert decontaminate.contaminated(docs.where(F.lit(False)), benchmark(spark, ["a b c d e"])).count() == 0
    assert decontaminate.clean_rows(docs, benchmark(spark, ["a b c d e"])).count() == 0


def test_gradients():
    rng = np.random.default_rng(1)
    network = language.Network.fresh(["a", "b", "c"], 4, rng)
    network.weights = {k: w.astype(np.float64) for k, w in network.weights.items()}
    codes, labels = rng.integers(0, 256, (3, 5)), np.array([0, 1, 2])
    _, grads = network.gradients(codes, labels)
    for name, weights in network.weights.items():
        at = (codes[0, 1], 3) if name.endswith("byte") else tuple(rng.integers(0, s) for s in weights.shape)
        before, losses = weights[at], []
        for step in (1e-3, -1e-3):
            weights[at] = before + step
            losses.append(network.gradients(codes, labels)[0])
        weights[at] = before
        assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(grads[name][at], rel=0.02, abs=1e-5)


@pytest.fixture(scope="module")
def network():
    random.seed(3)
    syllables = {"xx": "ba be bi bo bu".split(), "yy": "ka ke ki ko ku".split()}
    samples = [(" ".join("".join(random.choices(own, k=3)) for _ in range(200)), name) for name, own in syllables.items()]
    return language.fit(samples, steps=200)


def test_labels(documents, network, odd):
    rows = [*odd, (20, "babebi BOBU, bubabi"), (21, "kakeki 12 koku"), (22, "12 34 !"), (23, "ba" * 50_000)]
    found = {r.doc_id: r for r in language.identify(documents(rows), network, {"held_out": language.held_out()}).collect() if r.doc_id}
    assert (found[20].lang_pred, found[21].lang_pred, found[23].lang_pred) == ("xx", "yy", "xx")
    assert min(found[20].score, found[21].score) > 0.9
    assert {i: (found[i].lang_pred, found[i].score) for i in (1, 2, 3, 22)} == dict.fromkeys((1, 2, 3, 22), ("und", 0.0))
    assert all(0 <= r.score <= 1 for r in found.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    docs = documents(rows)
    kept = language.in_known_languages(docs, network, 0.6)
    assert kept.columns == docs.columns
    assert {20, 21, 23} <= {r.doc_id for r in kept.collect()} and not {1, 2, 3, 22} & {r.doc_id for r in kept.collect()}


def plain_probabilities(network, text):
    """The network over a whole text, byte by byte, in double precision."""
    w = {k: v.astype(np.float64) for k, v in network.weights.items()}
    sides = []
    for side in ("ahead", "back"):
        states, h = [], np.zeros(w[f"{side}_state"].shape[0])
        n = len(h)
        for byte in text.lower() if side == "ahead" else text.lower()[::-1]:
            x, s = w[f"{side}_byte"][byte], h @ w[f"{side}_state"]
            z, r = (1 / (1 + np.exp(-(x[i * n : i * n + n] + s[i * n : i * n + n]))) for i in (0, 1))
            c = np.tanh(x[2 * n :] + r * s[2 * n :])
            h = c + z * (h - c)
            states.append(h)
        sides.append(np.array(states if side == "ahead" else states[::-1]))
    p = np.exp(np.concatenate(sides, 1) @ w["out"] + w["bias"])
    return p / p.sum(1, keepdims=True)


def test_every_byte_is_labelled_across_words(network):
    text = "Babebi, 12 kakeki\n- é bobu.".encode()
    p = network.label_bytes(text)
    assert p.shape == (len(text), 2)
    assert p == pytest.approx(plain_probabilities(network, text), abs=1e-4)
    letters = [byte >= 128 or chr(byte).isalpha() for byte in text]
    assert language.pool(network, [text, b"", text])[0] == pytest.approx(p[letters].mean(0), abs=1e-5)


def test_pieces_overlap_at_characters():
    text = ("é" * 301 + "a" + "\U0001f600" * 500 + "中").encode()
    pieces = language.pieces_of(text)
    assert [first for _, first, _, _ in pieces[1:]] == [last for _, _, last, _ in pieces[:-1]]
    assert (pieces[0][0], pieces[0][1], pieces[-1][2], pieces[-1][3]) == (0, 0, len(text), len(text))
    for start, first, last, end in pieces:
        for part in (text[start:end], text[first:last], text[start:first]):
            part.decode()
        assert last - first <= language.PIECE + 3 and (first - start >= language.CONTEXT or start == 0)
    assert language.pieces_of(b"") == []


def test_pieces_hardly_differ_from_the_whole(network):
    text = " ".join(random.Random(1).choices(["babebi", "bobabu", "bubo,", "bi."], k=400)).encode()
    assert len(language.pieces_of(text)) > 4
    assert network.label_bytes(text) == pytest.approx(plain_probabilities(network, text), abs=0.02)


def test_pooling_does_not_depend_on_what_is_read_together(network, monkeypatch):
    texts = [("babebi kakeki " * k)[: 7 * k].encode() for k in range(40)] + [b"ba" * 2000]
    alone = np.concatenate([language.pool(network, [text]) for text in texts])
    assert language.pool(network, texts) == pytest.approx(alone, abs=1e-5)
    monkeypatch.setattr(language, "TOGETHER", 3)
    assert language.pool(network, texts) == pytest.approx(alone, abs=1e-5)


def test_the_order_of_words_tells_languages_apart(documents):
    """Both languages have the same words; only what follows what differs, so a reader of single words can't tell."""
    rng = random.Random(8)
    words = {"first": ["ba", "ko"], "second": ["ko", "ba"]}
    make = lambda pair, n: " ".join(f"{pair[0]} {pair[0]} {pair[1]}" for _ in range(n))
    samples = [(make(pair, rng.randint(30, 60)), name) for name, pair in words.items() for _ in range(20)]
    network = language.fit(samples, steps=250)
    rows = [(i, make(words["first" if i % 2 else "second"], 5 + i)) for i in range(1, 21)]
    found = {row.doc_id: row.lang_pred for row in language.identify(documents(rows), network).collect()}
    assert found == {i: "first" if i % 2 else "second" for i, _ in rows}


def test_only_letters_are_letters(documents, network):
    rows = [(1, "½ ² Ⅷ ①"), (2, "½ é"), (3, "_ 1 \u0301"), (4, "ª")]
    found = {row.doc_id: row.lang_pred for row in language.identify(documents(rows), network).collect()}
    assert found[1] == found[3] == "und" and "und" not in (found[2], found[4])


def test_the_sample_is_bounded_however_often_rows_repeat(frame, monkeypatch):
    taken = []
    monkeypatch.setattr(language, "fit", lambda samples: taken.extend(samples) or language.Network.fresh(["a"], 2, np.random.default_rng(0)))
    monkeypatch.setattr(language, "TRAIN_ROWS", 7)
    docs = frame([(5, f"text {i}", "a", "s") for i in range(300)] + [(5, "text", "b", "s")] * 300 + [(None, "x", "a", "s"), (6, None, "a", "s")])
    language.train(docs, F.lit(True))
    assert sorted(lang for _, lang in taken) == ["a"] * 7 + ["b"] * 7


def test_training_never_sees_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    network = language.train(docs, ~language.held_out())
    found = language.identify(docs, network, {"held_out": language.held_out()}).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)


def test_no_labels(documents):
    docs = documents([(1, "some text")])
    network = language.train(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert language.identify(docs, network).first().lang_pred == "und"
    assert language.identify(docs.where(F.lit(False)), network).count() == 0
