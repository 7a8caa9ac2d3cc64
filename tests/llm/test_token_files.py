"""Token files: blocks, files and tables against plain versions."""

import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from hoplens.llm import token_files as tf
from hoplens.session import scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


TOKENIZER = Tokenizer.from_file(VOCABULARY)


def plain_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


NUMBERS = st.one_of(st.integers(0, 50_000), st.integers(-(2**63), 2**63 - 1), st.just(7))


@given(st.lists(NUMBERS, min_size=1, max_size=300), st.integers(0, 100))
@settings(max_examples=200, deadline=None)
def test_blocks_give_their_numbers_back(values, percent):
    rows = np.array([values, values[::-1]], np.int64)
    for row, block in zip(rows, tf.pack_blocks(rows, percent)):
        assert tf.unpack_block(block).tolist() == row.tolist()


def test_width_follows_the_percentile_and_the_rest_are_exceptions():
    values = np.array([100 + i % 8 for i in range(1000)])
    values[::50] = 60_000
    block = tf.pack_blocks(values[None], 95)[0]
    lowest, count, width, rest, exceptions = tf.HEAD.unpack_from(block)
    assert (lowest, count, width, exceptions) == (100, 1000, 3, 20)
    assert tf.unpack_block(block).tolist() == values.tolist()
    wide = tf.HEAD.unpack_from(tf.pack_blocks(values[None], 100)[0])
    assert wide[2] == 16 and wide[4] == 0


@pytest.mark.parametrize("lengths", [[], [0], [1], [1024], [1023, 2, 0, 5000, 70_000, 1], [3] * 3000])
def test_a_file_gives_documents_and_any_stretch_of_ids(lengths):
    rng = np.random.default_rng(len(lengths))
    ids = [rng.integers(0, 50_257, n).astype("<u4") for n in lengths]
    names = [None] * min(2, len(ids)) + list(range(5, 5 + max(0, len(ids) - 2)))
    sink = io.BytesIO()
    writer = tf.Writer(sink)
    for name, own in zip(names, ids):
        writer.add([name], [len(own)], own)
    writer.end()
    reader = tf.Reader(pa.BufferReader(sink.getvalue()))
    place = 0
    for (name, start, stretches), wanted_name, wanted in zip(reader.documents(), names, ids, strict=True):
        got = [x.copy() for x in stretches]
        assert (name, start) == (wanted_name, place)
        assert (np.concatenate(got) if got else np.empty(0)).tolist() == wanted.tolist()
        place += len(wanted)
    flat = np.concatenate(ids) if ids else np.empty(0)
    for start, stop in [(0, 5), (1020, 1030), (2047, 2049), (60_000, 99_999), (place, place + 5)]:
        assert reader.numbers(reader.IDS, start, stop).tolist() == flat[start:stop].tolist()


def test_a_file_that_was_cut_short_is_refused():
    sink = io.BytesIO()
    writer = tf.Writer(sink)
    writer.add([1], [3], np.array([1, 2, 3]))
    writer.end()
    with pytest.raises(ValueError):
        tf.Reader(pa.BufferReader(sink.getvalue()[:-1]))


PARTS = st.sampled_from(
    [" ", " ", " ", "a", "the", "1", "'s", "'ll", "\n", "\t", ".", ",", "-", "é", "ß", "中", " ", " ", "\x1c", "\x85", "᠎"]
    + ["​", "½", "é", "\U0001f600", "<|endoftext|>", "\r\n", "x" * 50, "\u0000"]
)


@given(st.lists(PARTS, max_size=30))
@settings(max_examples=400, deadline=None)
def test_stretches_have_the_ids_of_the_whole_text(parts):
    text = "".join(parts)
    known = tf._Known(VOCABULARY)
    assert np.frombuffer(tf.ids_of(text, known), "<u4").tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids


@given(st.lists(PARTS, max_size=30))
@settings(max_examples=400, deadline=None)
def test_splits_that_no_word_follows_are_found_at_once(parts):
    text = "".join(parts)
    for between, loose in ((" ", tf.LOOSE_SPACE), ("\n", tf.LOOSE_END)):
        assert bool(loose.search(text)) == (not all(map(tf._begins_word, text.split(between)[1:])))


def test_plain_words_are_not_looked_at_one_by_one(monkeypatch):
    looked = []
    monkeypatch.setattr(tf, "_begins_word", lambda stretch: looked.append(stretch) or stretch[:1].isalnum())
    text = "\n".join(["the plain words of a line, été"] * 20)
    known = tf._Known(VOCABULARY)
    assert np.frombuffer(tf.ids_of(text, known), "<u4").tolist() == plain_ids(text)
    assert not looked


@pytest.mark.parametrize("width", range(65))
def test_numbers_of_every_width(width):
    rng = np.random.default_rng(width)
    rows = rng.integers(0, 1 << 64, (3, 101), np.uint64, endpoint=False) >> np.uint64(64 - width) if width else np.zeros((3, 101), np.uint64)
    packed = tf._packed(rows, width) if width else np.empty((3, 0), np.uint8)
    assert tf._unpacked(packed, 101, width).tolist() == rows.tolist()


def test_numbers_are_spread_to_no_more_bits_than_their_type_has(monkeypatch):
    spread = []
    unpackbits = np.unpackbits
    monkeypatch.setattr(np, "unpackbits", lambda *args, **options: spread.append(unpackbits(*args, **options)) or spread[-1])
    ids = np.arange(1024)[None] * 30
    block = tf.pack_blocks(ids, 100)[0]
    assert tf.HEAD.unpack_from(block)[2] == 15 and sum(x.size for x in spread) <= 16 * 1024
    assert tf.unpack_block(block).tolist() == ids[0].tolist()


def plain_table(rows, end):
    """Documents by doc_id, nulls first; equal doc_ids are left to a check of their own."""
    place, wanted = 0, []
    for doc_id, text in sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0)):
        ids = [*plain_ids(text), end]
        wanted.append((doc_id, place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        place += len(ids)
    return wanted


def test_tables_come_back_in_order(spark, documents, monkeypatch):
    monkeypatch.setattr(tf, "FILE_BYTES", 2000)
    rows = [(i * 37 % 400 - 50, f"text {i} " * (i % 40)) for i in range(400)] + [(1000, None), (1001, "#" * 9), (1002, "é " * 30_000)]
    folder = scratch_path(spark, "token-test")
    manifest = tf.write_tokens(documents(rows), folder, VOCABULARY, 2)
    assert manifest.count() > 10
    got = [tuple(row) for row in tf.read_tokens(spark, folder, with_ids=False).orderBy("start").collect()]
    assert got == plain_table(rows, 2)
    whole = {row.doc_id: row for row in tf.read_tokens(spark, folder).collect()}
    assert np.frombuffer(whole[1001].ids, "<u4").tolist() == [*plain_ids("#" * 9), 2]
    assert all(zlib.crc32(row.ids) == row.ids_crc32 and len(row.ids) == 4 * row.n_tokens for row in whole.values())


def test_odd_rows(spark, documents, odd):
    folder = scratch_path(spark, "token-test")
    tf.write_tokens(documents(odd + [(None, "again")]), folder, VOCABULARY, 2)
    got = tf.read_tokens(spark, folder, with_ids=False).orderBy("start").collect()
    assert [row.doc_id for row in got] == [None, None, 1, 2, 3, 4, 4, 5, 6, 7]
    place = 0
    for row in got:
        assert row.start == place
        place += row.n_tokens
    crcs = {zlib.crc32(np.array([*plain_ids(text), 2], "<u4").tobytes()) for _, text in odd}
    assert crcs <= {row.ids_crc32 for row in got}


def test_equal_rows_fill_several_files(spark, documents, monkeypatch):
    monkeypatch.setattr(tf, "FILE_BYTES", 2000)
    folder = scratch_path(spark, "token-test")
    manifest = tf.write_tokens(documents([(5, "one text of copies")] * 900 + [(6, "other")], parts=8), folder, VOCABULARY, 2)
    assert max(row.n_docs for row in manifest.collect()) < 400
    got = tf.read_tokens(spark, folder, with_ids=False).orderBy("start").collect()
    assert len(got) == 901 and got[-1].doc_id == 6 and len({row.ids_crc32 for row in got[:-1]}) == 1


def test_empty_table(spark, documents):
    folder = scratch_path(spark, "token-test")
    assert tf.write_tokens(documents([(1, "x")]).limit(0), folder, VOCABULARY, 2).count() == 0
    assert tf.read_tokens(spark, folder).count() == 0


def test_files_of_lost_attempts_are_not_read(spark, documents):
    folder = scratch_path(spark, "token-test")
    tf.write_tokens(documents([(1, "one"), (2, "two")]), folder, VOCABULARY, 2)
    with open(f"{folder}/ids-00000-lost.bin", "wb") as file:
        file.write(b"half a file")
    assert tf.read_tokens(spark, folder).count() == 2


def test_query_equals_plain(spark):
    from hoplens.llm.queries import QUERIES

    path = "/root/testdata/sf0.001"
    rows = [tuple(row) for row in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_token_files"](spark, path).orderBy("start").collect()
    assert [tuple(row) for row in got] == plain_table(rows, 2)
