"""Token ids of documents in files of patched frame-of-reference blocks.

A file holds a run of documents in ascending ``doc_id`` order as three sequences of whole numbers: the ids of all documents in a row,
the documents' ``doc_id`` and their numbers of ids. Each sequence is cut into blocks of ``BLOCK`` numbers. A block keeps its
minimum, and of every number the low bits of its distance from the minimum, at the width that ``PERCENT`` of the block's
distances need. Wider ones are exceptions: a list of their places and one of their high bits. The starts of all blocks are the
file's index, so any stretch of ids is read without the rest.

    file     = MAGIC, blocks of the three sequences as they fill, index, trailer
    block    = minimum (i64), count (u16), width (u8), width of high bits (u8), exceptions (u16),
               packed low bits, places of exceptions (u16 each), packed high bits
    index    = for each sequence the offsets (u64) of its blocks
    trailer  = for each sequence numbers and blocks (u64 each), documents without a doc_id (u64), offset of the index (u64), MAGIC

All numbers are little-endian, bits are packed from the lowest on.
"""

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hoplens.llm import words
from hoplens.llm.common import whole_text
from hoplens.sources.appended import store_of

MAGIC = b"HLTOKEN1"
#: Numbers in a block, at most 65535.
BLOCK = 1024
#: Of a block's distances from its minimum, so many in a hundred fit the packed width.
PERCENT = 95
#: Blocks that are packed or unpacked at a time.
TOGETHER = 64
#: Bytes of text for one file, until there are MOST_FILES of them; then files get longer. A task streams, so this bounds no memory.
FILE_BYTES, MOST_FILES = 32 << 20, 20_000
#: Stretches of text whose ids a worker keeps: so many of late and as many from before. Longer ones are not kept.
KNOWN, KNOWN_LENGTH = 1_000_000, 40
#: Signs that are cut off behind a letter or digit, and those letters and digits.
SIGNS = ".,;:!?)]}\"'-/"
ENDS = frozenset(chr(c) for c in range(0x250) if chr(c).isalnum())

HEAD = struct.Struct("<qHBBH")
TRAILER = struct.Struct("<8Q8s")


# Blocks


def _kind(width: int) -> np.dtype:
    """The smallest type that holds numbers below 2**width."""
    return np.dtype(next(f"<u{size}" for size in (1, 2, 4, 8) if width <= 8 * size))


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of numbers below 2**width as rows of bytes."""
    kind = _kind(width)
    whole = values.astype(kind)[..., None].view(np.uint8)
    if width == 8 * kind.itemsize:
        return whole.reshape(len(values), -1)
    bits = np.unpackbits(whole, axis=-1, bitorder="little")
    return np.packbits(bits[..., :width].reshape(len(values), -1), axis=-1, bitorder="little")


@lru_cache(maxsize=256)
def _bit_places(count: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in which packed numbers begin, and their first bits there."""
    at = np.arange(count, dtype=np.int64) * width
    return at >> 3, (at & 7).astype(np.uint64)


def _unpacked(rows: np.ndarray, count: int, width: int) -> np.ndarray:
    """Inverse of ``_packed`` for rows of ``count`` numbers."""
    if not width:
        return np.zeros((len(rows), count), np.uint64)
    if width > 57:  # a number may lie in nine bytes
        full = np.zeros((len(rows), count, 64), np.uint8)
        full[..., :width] = np.unpackbits(rows, axis=-1, bitorder="little", count=count * width).reshape(len(rows), count, width)
        return np.packbits(full, axis=-1, bitorder="little").view("<u8")[..., 0].astype(np.uint64)
    first, shift = _bit_places(count, width)
    padded = np.zeros((len(rows), rows.shape[1] + 8), np.uint8)
    padded[:, :-8] = rows
    # The eight bytes from each byte on, as a number.
    eight = np.ndarray((len(rows), rows.shape[1] + 1), "<u8", padded, strides=(padded.shape[1], 1))
    return (eight[:, first] >> shift) & np.uint64((1 << width) - 1)


def pack_blocks(values: np.ndarray, percent: int = PERCENT) -> list[bytes]:
    """Rows of whole numbers of 64 bits as one block each."""
    lowest = values.min(axis=1)
    distance = values.astype(np.uint64) - lowest.astype(np.uint64)[:, None]
    place = max(0, -(-values.shape[1] * percent // 100) - 1)
    most = np.partition(distance, place, axis=1)[:, place]
    widths = np.array([int(x).bit_length() for x in most])
    full = np.array([int(x).bit_length() for x in distance.max(axis=1)])
    blocks: list[bytes] = [b""] * len(values)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        own = distance[rows]
        low = own & np.uint64((1 << int(width)) - 1)
        packed = _packed(low, int(width)) if width else np.empty((len(rows), 0), np.uint8)
        high = own >> np.uint64(width) if width < 64 else np.zeros_like(own)
        for i, row in enumerate(rows):
            places = np.flatnonzero(high[i]) if full[row] > width else np.empty(0, np.int64)
            rest = int(full[row] - width)
            highs = _packed(high[i][places][None], rest).tobytes() if len(places) else b""
            head = HEAD.pack(int(lowest[row]), values.shape[1], int(width), rest, len(places))
            blocks[row] = b"".join((head, packed[i].tobytes(), places.astype("<u2").tobytes(), highs))
    return blocks


def unpack_block(block: bytes) -> np.ndarray:
    """The numbers of one block."""
    lowest, count, width, rest, n = HEAD.unpack_from(block)
    at = HEAD.size
    size = (count * width + 7) // 8
    distance = _unpacked(np.frombuffer(block, np.uint8, size, at)[None], count, width)[0]
    at += size
    if n:
        places = np.frombuffer(block, "<u2", n, at)
        highs = _unpacked(np.frombuffer(block, np.uint8, (n * rest + 7) // 8, at + 2 * n)[None], n, rest)[0]
        distance[places] |= highs << np.uint64(width)
    return (distance + np.uint64(lowest & (2**64 - 1))).view(np.int64)


class _Sequence:
    """Numbers of one sequence on their way into a file."""

    def __init__(self, sink: "Writer"):
        self.sink, self.starts, self.count, self.held, self.n_held = sink, [], 0, [], 0

    def add(self, values: np.ndarray) -> None:
        self.held.append(values.astype(np.int64, copy=False))
        self.n_held += len(values)
        self.count += len(values)
        if self.n_held >= BLOCK * TOGETHER:
            self._put(self.n_held // BLOCK)

    def _put(self, blocks: int) -> None:
        values = np.concatenate(self.held) if len(self.held) > 1 else self.held[0]
        cut = blocks * BLOCK
        for first in range(0, cut, BLOCK * TOGETHER):
            part = values[first : min(cut, first + BLOCK * TOGETHER)]
            self.starts += self.sink.put(pack_blocks(part.reshape(-1, BLOCK)))
        # A copy, so that what is written can go.
        self.held, self.n_held = [values[cut:].copy()], len(values) - cut

    def end(self) -> None:
        if self.n_held >= BLOCK:
            self._put(self.n_held // BLOCK)
        if self.n_held:
            self.starts += self.sink.put(pack_blocks(np.concatenate(self.held)[None]))


class Writer:
    """One file, written from front to back. Documents without a ``doc_id`` come first."""

    def __init__(self, stream):
        self.stream, self.at, self.unnamed = stream, 0, 0
        self.ids, self.names, self.lengths = (_Sequence(self) for _ in range(3))
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def put(self, blocks: list[bytes]) -> list[int]:
        starts = [self.at]
        for block in blocks[:-1]:
            starts.append(starts[-1] + len(block))
        self._write(b"".join(blocks))
        return starts

    def add(self, names: list[int | None], lengths: list[int], ids: np.ndarray) -> None:
        """Documents in order, and the ids of all of them in a row."""
        self.unnamed += sum(name is None for name in names)
        self.names.add(np.array([name or 0 for name in names], np.int64))
        self.lengths.add(np.array(lengths, np.int64))
        self.ids.add(ids)

    def end(self) -> None:
        sequences = (self.ids, self.names, self.lengths)
        for sequence in sequences:
            sequence.end()
        index = self.at
        for sequence in sequences:
            self._write(np.array(sequence.starts, "<u8").tobytes())
        counts = [number for sequence in sequences for number in (sequence.count, len(sequence.starts))]
        self._write(TRAILER.pack(*counts, self.unnamed, index, MAGIC))


class Reader:
    """One file; ``source`` can be read at any place."""

    IDS, NAMES, LENGTHS = range(3)

    def __init__(self, source):
        self.source = source
        size = source.size()
        *counts, self.unnamed, self.index, magic = TRAILER.unpack(self._bytes(size - TRAILER.size, TRAILER.size))
        if magic != MAGIC or self._bytes(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of token ids, or one cut short")
        self.counts, self.blocks = counts[::2], counts[1::2]

    def _bytes(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        return self.source.read(length)

    def _offsets(self, sequence: int, first: int, last: int) -> np.ndarray:
        """Starts of blocks ``first`` to ``last``; of the one that is no block any more, a place that it cannot exceed."""
        at = self.index + 8 * (sum(self.blocks[:sequence]) + first)
        return np.frombuffer(self._bytes(at, 8 * (last - first)), "<u8").astype(np.int64)

    def _block(self, at: int) -> np.ndarray:
        _, count, width, rest, n = HEAD.unpack(self._bytes(at, HEAD.size))
        return unpack_block(self._bytes(at, HEAD.size + (count * width + 7) // 8 + 2 * n + (n * rest + 7) // 8))

    def numbers(self, sequence: int, start: int, stop: int) -> np.ndarray:
        """Numbers ``start`` to ``stop`` of a sequence; only their blocks are read."""
        stop = min(stop, self.counts[sequence])
        if start >= stop:
            return np.empty(0, np.int64)
        first, last = start // BLOCK, (stop - 1) // BLOCK + 1
        values = np.concatenate([self._block(at) for at in self._offsets(sequence, first, last).tolist()])
        return values[start - first * BLOCK : stop - first * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """Name, first id's place and ids of each document; ids come in stretches and are read as they are taken."""
        place = 0
        for first in range(0, self.counts[self.NAMES], BLOCK):
            names = self.numbers(self.NAMES, first, first + BLOCK).tolist()
            lengths = self.numbers(self.LENGTHS, first, first + BLOCK).tolist()
            for number, (name, length) in enumerate(zip(names, lengths), first):
                yield None if number < self.unnamed else name, place, self._stretches(place, place + length)
                place += length

    def _stretches(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """Ids from ``start`` to ``stop``. The last stretch of blocks read is kept, as documents follow each other."""
        size = BLOCK * TOGETHER
        while start < stop:
            first = start // size * size
            if getattr(self, "kept_from", None) != first:
                self.kept, self.kept_from = self.numbers(self.IDS, first, first + size).astype("<u4"), first
            end = min(stop, first + size)
            yield self.kept[start - first : end - first]
            start = end


# Ids of texts


@cache
def _tokenizer(vocabulary: str):
    """The library's tokenizer, its added tokens, and whether it cuts a text into words by the rules that ``ids_of`` relies on."""
    import json

    from tokenizers import Tokenizer

    with open(vocabulary, encoding="utf-8") as file:
        stated = json.load(file)
    cutting = stated["pre_tokenizer"] or {}
    byte_level = (
        stated["normalizer"] is None
        and cutting.get("type") == "ByteLevel"
        and cutting.get("use_regex", True)
        and not cutting.get("add_prefix_space", True)
    )
    return Tokenizer.from_file(vocabulary), tuple(token["content"] for token in stated["added_tokens"]), byte_level


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it can be printed, else one from U+0100 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in printed]
    return {byte: chr(byte) for byte in printed} | {byte: chr(256 + i) for i, byte in enumerate(others)}


BYTE_LETTERS = _byte_letters()


class _Known(dict):
    """Ids of stretches of text, as bytes. In ``spaced``, stretches follow a space that is no part of the key.

    What was met since the last time that it was full stays known, and what was met in the time before as long as it is met again.
    """

    def __init__(self, vocabulary: str, bare: "_Known | None" = None):
        self.tokenizer, self.added, self.byte_level = _tokenizer(vocabulary)
        self.earlier: dict[str, bytes] = {}
        self.bare = self if bare is None else bare
        self.space = "" if bare is None else " "
        self.spaced = _Known(vocabulary, self) if bare is None else self

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word_ids(self, word: str) -> bytes:
        """Ids of a word of letters, which the library need not look for the words in."""
        letters = (self.space + word).encode().decode("latin-1").translate(BYTE_LETTERS)
        return np.array([token.id for token in self.tokenizer.model.tokenize(letters)], "<u4").tobytes()

    def __missing__(self, stretch: str) -> bytes:
        ids = self.earlier.get(stretch)
        if ids is None:
            word = stretch.rstrip(SIGNS)
            if word and word != stretch and word[-1] in ENDS:
                ids = self[word] + self.bare[stretch[len(word) :]]
            elif stretch.isalpha() and max(stretch) in ENDS:
                ids = self.word_ids(stretch)
            else:
                ids = self.ids(self.space + stretch)
        if len(stretch) <= KNOWN_LENGTH:
            if len(self) >= KNOWN:
                self.earlier = dict(self)
                self.clear()
            self[stretch] = ids
        return ids


@cache
def _known(vocabulary: str) -> _Known:
    """What a worker keeps from task to task."""
    return _Known(vocabulary)


def _begins_word(stretch: str) -> bool:
    """Whether the first character is surely no white space."""
    return stretch[:1].isalnum() or "!" <= stretch[:1] <= "~"


#: What ``_begins_word`` tells of all parts of a split at once: a space or line end that no word follows.
LOOSE_SPACE, LOOSE_END = (re.compile(between + r"(?![!-~\w])") for between in (" ", "\n"))


def _joined(parts: list[str], between: str) -> list[str]:
    """Parts that were split apart, put together again where the split was not before a word."""
    first, *others = parts
    joined = [first]
    for other in others:
        if _begins_word(other):
            joined.append(other)
        else:
            joined[-1] += between + other
    return joined


def ids_of(text: str, known: _Known) -> bytes:
    """The ids of a text by the library, four bytes each.

    A byte-level vocabulary cuts a text before the last white space in front of a word, behind it if that is a line end, and between
    letters or digits and signs, whatever stands around. So a text is cut into stretches there, and those met again are not
    encoded again. A text with an added token in it is encoded in one go.
    """
    if not known.byte_level or any(token in text for token in known.added):
        return known.ids(text)
    found = []
    lines = text.split("\n")
    if LOOSE_END.search(text):
        lines = _joined(lines, "\n")
    loose = LOOSE_SPACE.search(text) is not None
    for number, line in enumerate(lines):
        if number:
            found.append(known["\n"])
        stretches = line.split(" ")
        if loose and LOOSE_SPACE.search(line):
            stretches = _joined(stretches, " ")
        found.append(known[stretches[0]])
        found += map(known.spaced.__getitem__, stretches[1:])
    return b"".join(found)


# Tables


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int) -> DataFrame:
    """Write the ids of every row's text, and ``end_id`` after each, into files under ``folder``; return its manifest.

    Files follow each other in the order of ``part``, and rows lie in them in ascending order of ``doc_id`` (nulls first), rows with
    the same one by a hash of their text; equal rows can't be told apart. Null texts are empty: a document of the end alone. An
    empty table has no files. Other columns are not read.

    Rows are dealt out by range of that order, with a row number last, so that rows with one ``doc_id`` or equal rows fill as many
    files as they need. A task writes its file under a name of its own and the manifest takes the names of tasks that
    were counted in: what a lost or second attempt leaves behind is read by nobody. ``folder`` is in the local
    file system of a single machine, or in a store that all executors reach by pyarrow's name for it.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-total // max(FILE_BYTES, total // MOST_FILES)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, known, part = None, None, TaskContext.get().partitionId()
        for batch in batches:
            for rows, contents in words.sliced(batch):
                if writer is None:
                    store, root = store_of(folder)
                    store.create_dir(root, recursive=True)
                    name = f"ids-{part:05d}-{uuid.uuid4().hex}.bin"
                    stream, known = store.open_output_stream(f"{root}/{name}"), _known(vocabulary)
                    writer = Writer(stream)
                end = np.array([end_id], "<u4").tobytes()
                ids = [ids_of(text.decode(), known) + end for text in contents]
                writer.add(rows.column("doc_id").to_pylist(), [len(x) // 4 for x in ids], np.frombuffer(b"".join(ids), "<u4"))
        if writer is not None:
            writer.end()
            stream.close()
            numbers = {"part": [part], "file": [name], "n_docs": [writer.names.count], "n_ids": [writer.ids.count]}
            yield pa.RecordBatch.from_pydict(numbers, schema=_MANIFEST)

    order = [F.col("doc_id").asc_nulls_first(), "tie", "row"]
    placed = texts.select("*", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    dealt = placed.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")
    written = dealt.mapInArrow(words.frugal(write), "part int, file string, n_docs long, n_ids long")
    written.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


_MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Every document of the files under ``folder``: ``doc_id, start, n_tokens, ids_crc32`` and ``ids``, four bytes each.

    ``start`` counts the ids of all documents before it. ``ids_crc32`` is taken from the ids that were read.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    files = manifest.count()
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = manifest.select("part", "file", before.alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['file']}") as source:
                    yield from _documents(Reader(source), row["before"], with_ids)

    columns = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return listed.repartitionByRange(max(1, files), "part").mapInArrow(words.frugal(read), columns)


def _documents(reader: Reader, before: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Documents of a file in batches of a bounded size."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    rows, size = [], 0
    for name, start, stretches in reader.documents():
        crc, count, held = 0, 0, []
        for ids in stretches:
            crc, count = zlib.crc32(ids, crc), count + len(ids)
            if with_ids:
                held.append(ids.tobytes())
        rows.append((name, before + start, count, crc) + (b"".join(held),) * with_ids)
        size += 40 + 4 * count * with_ids
        if size >= words.SLICE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=names)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=names)
