"""Documents packed into token sequences of one length."""

import json
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from hoplens.llm import words
from hoplens.llm.common import cut

#: The id that ends a document.
END = 0
#: Pieces of one length that are numbered by one task, until there are MOST_BLOCKS blocks of them; then blocks get larger.
BLOCK_PIECES, MOST_BLOCKS = 2000, 500_000
#: Capacities up to here are planned: some lengths and a number of pieces fit one number of 64 bits.
MOST_CAPACITY = 1 << 19

#: Strings that are one token wherever a text holds them, with their ids.
Special = tuple[tuple[str, int], ...]


def added_tokens(vocabulary: str) -> Special:
    """The added tokens of a vocabulary file of the library ``tokenizers``."""
    with open(vocabulary, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    for token in added:
        if any(token[option] for option in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{token['content']!r} is not matched as plain text")
    return tuple((token["content"], token["id"]) for token in added)


@cache
def _encoder(ranks: str, pattern: str, special: Special):
    import base64

    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens=dict(special))


def _ids(text: str, ranks: str, pattern: str, special: Special) -> np.ndarray:
    """The ids of a text, and END."""
    encoder = _encoder(ranks, pattern, special)
    return np.array([*(encoder.encode(text, allowed_special="all") if special else encoder.encode_ordinary(text)), END], "<u4")


def pieces_of(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece; only the first may be shorter than the others."""
    first = (length - 1) % capacity + 1
    return [(0, first)] + [(start, capacity) for start in range(first, length, capacity)]


def cut_pieces(docs: DataFrame, capacity: int, ranks: str, pattern: str, special: Special = ()) -> DataFrame:
    """Token pieces of every row: ``doc_id, piece, start, length, ids_crc32``. Tokens themselves aren't kept."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in words.sliced(batch):
                row, piece, start, length, crc = [], [], [], [], []
                for i, text in enumerate(texts):
                    ids = _ids(text.decode(), ranks, pattern, special)
                    for k, (at, size) in enumerate(pieces_of(len(ids), capacity)):
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(ids[at : at + size]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(row, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=schema.names,
                )

    return docs.select("doc_id", "text").mapInArrow(words.frugal(encode), schema)


class _Bins:
    """Equal bins: how many, what each holds as (length, copies), and its free room."""

    def __init__(self, number: int, room: int, items: tuple[tuple[int, int], ...] = ()):
        self.number, self.room, self.items = number, room, items

    def with_items(self, number: int, length: int, copies: int) -> "_Bins":
        return _Bins(number, self.room - length * copies, (*self.items, (length, copies)))


def plan_bins(counts: dict[int, int], capacity: int) -> list[_Bins]:
    """Bins for pieces of which only the number of each length is given.

    Lengths above a third of the capacity are matched first, from the longest: each takes the longest partner of that kind
    that fits, so a bin holds two of them at most. Shorter lengths follow from the longest, each into the tightest room, and
    new bins where none is left. Equal lengths move together: a plan takes at most a few kinds of bins for each length, at
    any number of pieces.
    """
    left = {length: number for length, number in counts.items() if number}
    #: Large lengths of which there are pieces left, and the rooms of the bins, both ascending.
    large = sorted(length for length in left if 3 * length > capacity)
    rooms: list[int] = []
    bins: dict[int, list[_Bins]] = {}

    def put(group: _Bins) -> None:
        if group.number:
            if group.room not in bins:
                insort(rooms, group.room)
                bins[group.room] = []
            bins[group.room].append(group)

    def take(length: int, number: int) -> None:
        left[length] -= number
        if not left[length]:
            del large[bisect_left(large, length)]

    while large:
        length = large[-1]
        at = bisect_right(large, min(length, capacity - length)) - 1
        if at >= 0 and large[at] == length and left[length] < 2:
            at -= 1
        partner = large[at] if at >= 0 else None
        one = _Bins(0, capacity)
        if partner is None:
            number = left[length]
            put(one.with_items(number, length, 1))
        elif partner == length:
            number = left[length] // 2
            put(one.with_items(number, length, 2))
            number *= 2
        else:
            number = min(left[length], left[partner])
            put(one.with_items(0, length, 1).with_items(number, partner, 1))
            take(partner, number)
        take(length, number)
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        number, at = left[length], bisect_left(rooms, length)
        while number and at < len(rooms):
            room = rooms[at]
            # What is put back into smaller rooms does not fit the length any more, unless it has the room's rest.
            fit, groups = room // length, bins.pop(room)
            del rooms[at]
            while groups and number:
                group = groups.pop()
                full = min(group.number, number // fit)
                put(group.with_items(full, length, fit))
                number -= full * fit
                rest = group.number - full
                if rest and number:  # the last bin that takes some
                    put(group.with_items(1, length, number))
                    number, rest = 0, rest - 1
                if rest:
                    groups.append(_Bins(rest, group.room, group.items))
            for group in groups:
                put(group)
            at = bisect_right(rooms, room)
        fit = capacity // length
        put(_Bins(0, capacity).with_items(number // fit, length, fit))
        if number % fit:
            put(_Bins(0, capacity).with_items(1, length, number % fit))
    return [group for groups in bins.values() for group in groups]


def _places(bins: list[_Bins]) -> np.ndarray:
    """For each length and run of its numbered pieces: first number, first sequence, copies in a sequence, offset there."""
    rows, base, taken = [], 0, {}
    for group in bins:
        offset = 0
        for length, copies in group.items:
            first = taken.get(length, 0)
            rows.append((length, first, base, copies, offset))
            taken[length] = first + group.number * copies
            offset += length * copies
        base += group.number
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int, ranks: str, pattern: str, special: Special = ()) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. ``ranks`` and ``pattern`` are a
    byte-level vocabulary and its splitting pattern; the vocabulary file lies on every executor. Strings of ``special`` tokens
    are one token each wherever a text holds them; without any they are ordinary text. Only documents longer than
    a sequence are cut. A null text is empty and has the end token alone; repeated rows are packed each; other columns are
    not read; an empty table gives no rows.

    The driver sees the number of pieces of each length, ``capacity`` rows at most, and plans bins for these numbers. Pieces
    are numbered within their length in blocks, as many as its number needs, and find their place in the plan by number. There are
    capacity + MOST_BLOCKS blocks at most, so their sizes can be sent to every task. A capacity beyond MOST_CAPACITY is refused.
    The plan has some five kinds of bins for each length, and a bin at most sqrt(2 capacity) lengths, whatever the input.
    """
    if not 0 < capacity <= MOST_CAPACITY:
        raise ValueError(f"a sequence holds 1 to {MOST_CAPACITY} tokens, not {capacity}")
    spark = docs.sparkSession
    pieces = cut(cut_pieces(docs, capacity, ranks, pattern, special))
    counted = cut(pieces.groupBy("length").agg(F.count("*").alias("n")))
    lengths = {row.length: row.n for row in counted.collect()}
    size = max(BLOCK_PIECES, sum(lengths.values()) // MOST_BLOCKS)
    # As many rows as lengths, so as the capacity at most. A frame of the driver's rows would take a second pool of Python workers.
    blocks = counted.select("length", F.expr(f"(n + {size - 1}) div {size}").alias("__blocks"))
    pieces = pieces.join(F.broadcast(blocks), "length").withColumn(
        "__block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("__blocks"))
    )
    counts = pieces.groupBy("length", "__block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "__block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    places = spark.sparkContext.broadcast(_places(plan_bins(lengths, capacity)))

    within = Window.partitionBy("length", "__block").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (
        pieces.withColumn("__rank", F.row_number().over(within))
        .join(F.broadcast(offsets), ["length", "__block"])
        .withColumn("number", F.col("__before") + F.col("__rank") - 1)
        .select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    )
    schema = T.StructType(
        [*numbered.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = places.value
        # A length's rank, below MOST_CAPACITY, and a number below 2**44 as one key.
        known = np.unique(plan[:, 0])
        keys = (np.searchsorted(known, plan[:, 0]) << 44) + plan[:, 1]
        for batch in batches:
            length, number = (batch.column(name).to_numpy() for name in ("length", "number"))
            _, first, base, copies, offset = plan[np.searchsorted(keys, (np.searchsorted(known, length) << 44) + number, "right") - 1].T
            index = number - first
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(5)),
                    pa.array(base + index // copies),
                    pa.array(offset + index % copies * length),
                ],
                names=schema.names,
            )

    return numbered.mapInArrow(place, schema)
