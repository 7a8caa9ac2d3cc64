"""Benchmark decontamination by greedy string tiling of shared words."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from hoplens.llm import words
from hoplens.llm.common import cut, row_key

#: Words that a tile has at least.
LEAST_TILE = 5
#: A document is contaminated where its tiles cover this part of a benchmark item.
COVERAGE = 0.8
#: Words of a benchmark whose seeds are sent to every task, told from its bytes; those of a larger one are a table to join with.
HELD_WORDS, WORD_BYTES = 2_000_000, 8
#: Of a seed's hash, the bits that documents' hashes are picked by before that join.
PICK_BITS = 24


class Seeds:
    """Items, and a sorted table of the hashes of their tiles' shortest form."""

    def __init__(self, items: list[tuple[object, bytes]], size: int):
        self.size = size
        self.ids = [item for item, _ in items]
        flat, counts = words.word_hashes([text for _, text in items], words.LETTERS)
        self.words = np.split(flat, np.cumsum(counts)[:-1]) if len(items) else []
        owners = [np.full(max(0, len(w) - size + 1), i) for i, w in enumerate(self.words)]
        hashes = np.concatenate([words.shingles(w, size) for w in self.words] or [np.empty(0, np.uint64)])
        owner = np.concatenate(owners or [np.empty(0, np.int64)])
        place = np.concatenate([np.arange(len(x)) for x in owners] or [np.empty(0, np.int64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner, self.place = hashes[order], owner[order].astype(np.int64), place[order].astype(np.int64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def near(self, hashes: np.ndarray) -> np.ndarray:
        """Positions whose hash is some seed's."""
        maybe = np.flatnonzero(self.filter[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(maybe) or not len(self.hashes):
            return maybe[:0]
        at = np.searchsorted(self.hashes, hashes[maybe])
        return maybe[self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes[maybe]]


def _rolled(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes and powers, from which the hash of any run of words follows."""
    with np.errstate(over="ignore"):
        powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(values), words.STEP))])
        # Sums of word x STEP**i; a run is compared after it is brought to a common power.
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values * powers[:-1])])
    return sums, powers


def tiles(item: np.ndarray, doc: np.ndarray, places: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiles of two word sequences: (start in the item, start in the document, length).

    Running Karp-Rabin: for a search length that falls from the item's length to ``least``, runs of unmarked words are met by
    their hash, extended while words are equal and unmarked, and marked from the longest on; what a marked run covers partly
    is searched again at shorter lengths. ``places`` are the document's positions from which ``least`` words occur in some
    item; every match starts at one.
    """
    marked_item, marked_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    item_sums, powers = _rolled(item)
    # Only stretches of the document around seeds matter.
    first, last = int(places[0]), int(places[-1]) + least
    doc_sums, doc_powers = _rolled(doc[first:last])
    top = max(len(item), last - first)
    powers = powers if len(powers) >= len(doc_powers) else doc_powers
    runs = np.split(places, np.flatnonzero(np.diff(places) != 1) + 1)
    found: list[tuple[int, int, int]] = []
    size = max(least, min(len(item), max(len(run) for run in runs) + least - 1))

    def key(sums: np.ndarray, at: int, length: int) -> int:
        # The power that the position brought in is lifted to the same top for both sequences.
        return int((sums[at + length] - sums[at]) * powers_to(top - at))

    cache: dict[int, np.uint64] = {}

    def powers_to(exponent: int) -> np.uint64:
        if exponent not in cache:
            cache[exponent] = np.uint64(pow(int(words.STEP), exponent, 1 << 64))
        return cache[exponent]

    with np.errstate(over="ignore"):
        while True:
            table: dict[int, list[int]] = {}
            for at in range(len(item) - size + 1):
                if not marked_item[at : at + size].any():
                    table.setdefault(key(item_sums, at, size), []).append(at)
            matches: list[tuple[int, int, int]] = []
            for run in runs if table else ():
                for at in range(int(run[0]), int(run[-1]) + least - size + 1):
                    if marked_doc[at : at + size].any():
                        continue
                    for start in table.get(key(doc_sums, at - first, size), ()):
                        # An inner part of a longer match is met there.
                        if start and at and item[start - 1] == doc[at - 1] and not (marked_item[start - 1] or marked_doc[at - 1]):
                            continue
                        length = 0
                        while (
                            start + length < len(item)
                            and at + length < len(doc)
                            and item[start + length] == doc[at + length]
                            and not (marked_item[start + length] or marked_doc[at + length])
                        ):
                            length += 1
                        if length >= size:
                            matches.append((-length, start, at))
            again = False
            for length, start, at in sorted(matches):
                if marked_item[start : start - length].any() or marked_doc[at : at - length].any():
                    again = True  # what is left of it may be long enough
                else:
                    marked_item[start : start - length] = marked_doc[at : at - length] = True
                    found.append((start, at, -length))
            if not again:
                if size == least:
                    return found
                size = max(least, size // 2)


def _covered(seeds: Seeds, doc: np.ndarray, near: np.ndarray, hashes: np.ndarray, coverage: float) -> Iterator[tuple]:
    """(item, tiles, item's words) of the items that a document's tiles cover enough."""
    low = np.searchsorted(seeds.hashes, hashes[near], "left")
    high = np.searchsorted(seeds.hashes, hashes[near], "right")
    index = np.repeat(low, high - low) + np.arange((high - low).sum()) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    owner, place, at = seeds.owner[index], seeds.place[index], np.repeat(near, high - low)
    for item in np.unique(owner):
        own = owner == item
        text = seeds.words[item]
        # All words of the item that some seed covers: no tiling covers more.
        reach = np.zeros(len(text) + 1, np.int64)
        starts = np.unique(place[own])
        np.add.at(reach, starts, 1)
        np.add.at(reach, starts + seeds.size, -1)
        if np.count_nonzero(np.cumsum(reach)[:-1]) < coverage * len(text):
            continue
        got = tiles(text, doc, np.unique(at[own]), seeds.size)
        if sum(length for _, _, length in got) >= coverage * len(text):
            yield int(item), got, len(text)


def _scan(seeds: Seeds, texts: list[bytes], coverage: float) -> Iterator[tuple[int, int, list, int]]:
    """(row, item, tiles, item's words) for texts that cover an item enough."""
    flat, counts = words.word_hashes(texts, words.LETTERS)
    with np.errstate(over="ignore"):
        hashes = words.shingles(flat, seeds.size)
    near = seeds.near(hashes)
    ends = np.cumsum(counts)
    row = np.searchsorted(ends, near, "right")
    within = near + seeds.size <= ends[row]  # not across texts
    near, row = near[within], row[within]
    for i in np.unique(row):
        start = int(ends[i] - counts[i])
        own = near[row == i] - start
        for item, got, length in _covered(seeds, flat[start : ends[i]], own, hashes[start:], coverage):
            yield int(i), item, got, length


def _items(benchmark: DataFrame, item: str) -> DataFrame:
    return benchmark.select(F.col(item).alias("item"), F.col("text").alias("text")).where(F.col("text").isNotNull())


def _held(items: DataFrame, size: int) -> Seeds | None:
    """The seeds of a benchmark small enough to be sent to every task."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > HELD_WORDS * WORD_BYTES:
        return None
    return Seeds([(row.item, row.text.encode()) for row in items.collect()], size)


def _grams(text: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A text's words and the hashes of ``size`` of them from each place on."""
    flat, _ = words.word_hashes([text], words.LETTERS)
    with np.errstate(over="ignore"):
        return flat, words.shingles(flat, size)


def _seed_table(items: DataFrame, size: int) -> DataFrame:
    """A row for each place of an item from which ``size`` words follow: ``gram, row, place, words``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in words.sliced(batch):
                for row, text in zip(part.column("row").to_pylist(), texts, strict=True):
                    flat, hashes = _grams(text, size)
                    n = len(hashes)
                    columns = [hashes.view(np.int64), np.full(n, row), np.arange(n, dtype=np.int32), np.full(n, len(flat), np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["gram", "row", "place", "words"])

    return items.select("row", "text").mapInArrow(words.frugal(read), "gram long, row long, place int, words int")


def _picked(seeds: DataFrame) -> np.ndarray:
    """Which leading bits some seed has: a bit for each of 2**PICK_BITS, however many seeds there are."""
    lead = F.shiftrightunsigned("gram", 64 - PICK_BITS) + 1
    maps = seeds.groupBy((F.bitmap_bucket_number(lead) - 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(lead)).alias("bits"))
    bits = np.zeros(1 << PICK_BITS >> 3, np.uint8)
    for row in maps.collect():
        bits[row.bucket * len(row.bits) : (row.bucket + 1) * len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return bits


def _reached(places: Column, size: int) -> Column:
    """Words that seeds at these places cover."""
    start = F.struct(F.lit(-size).alias("last"), F.lit(0).alias("covered"))

    def add(state: Column, place: Column) -> Column:
        return F.struct(place.alias("last"), (state["covered"] + F.least(F.lit(size), place - state["last"])).alias("covered"))

    return F.aggregate(F.array_sort(places), start, add, lambda state: state["covered"])


def _joined(docs: DataFrame, items: DataFrame, size: int, coverage: float) -> DataFrame:
    """Tiles of rows (``key``) and items (``row``) that cover enough, for a benchmark of any size.

    Documents are read once for the hashes that lead like some seed's; these are joined with the seeds. Pairs whose shared seeds
    cover too little of the item go no further, as no tiling covers more; for the others the texts are fetched and tiled.
    """
    texts = docs.select(row_key().alias("key"), "text").where(F.col("text").isNotNull())
    seeds = cut(_seed_table(items, size))
    picked = docs.sparkSession.sparkContext.broadcast(_picked(seeds))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, contents in words.sliced(batch):
                keys, grams = part.column("key").to_pylist(), []
                for text in contents:
                    own = np.unique(_grams(text, size)[1])
                    lead = (own >> np.uint64(64 - PICK_BITS)).astype(np.int64)
                    grams.append(own[(picked.value[lead >> 3] >> (lead & 7).astype(np.uint8)) & 1 == 1])
                row = np.repeat(np.arange(len(keys)), [len(x) for x in grams])
                flat = np.concatenate([np.empty(0, np.uint64), *grams]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(row)), pa.array(flat)], names=["key", "gram"])

    found = texts.mapInArrow(words.frugal(read), "key string, gram long").join(seeds, "gram")
    near = found.groupBy("key", "row").agg(F.collect_set("place").alias("places"), F.first("words").alias("words"))
    near = near.where(_reached(F.col("places"), size) >= coverage * F.col("words")).select("key", "row")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pair in batch.to_pylist():
                item, own = _grams(pair["item_text"].encode(), size)
                doc, hashes = _grams(pair["text"].encode(), size)
                got = tiles(item, doc, np.flatnonzero(np.isin(hashes, own)), size)
                matched = sum(length for _, _, length in got)
                if matched >= coverage * len(item):
                    longest = max(length for _, _, length in got)
                    rows.append((pair["key"], pair["row"], len(got), matched, len(item), matched / len(item), longest))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32()]
            columns = zip(*rows) if rows else ((),) * len(kinds)
            names = ["key", "row", "tiles", "matched_words", "item_words", "coverage", "longest"]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=names)

    pairs = near.join(texts.dropDuplicates(["key"]), "key").join(items.select("row", F.col("text").alias("item_text")), "row")
    schema = "key string, row long, tiles int, matched_words int, item_words int, coverage double, longest int"
    return pairs.select("key", "row", "text", "item_text").mapInArrow(words.frugal(tile), schema)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, item: str = "item_id", least: int = LEAST_TILE, coverage: float = COVERAGE
) -> DataFrame:
    """Pairs of a document and a benchmark item that its words cover.

    Words are compared after lower-casing A-Z, with ASCII punctuation as white space. A pair is returned where tiles of
    ``least`` words or more cover ``coverage`` of the item's words, in any order: ``doc_id, item, tiles, matched_words, item_words,
    coverage, longest``. Null texts and items of fewer than ``least`` words match nothing; rows that repeat, on either side,
    each make their pairs; other columns are not read. An empty table on either side gives no pairs.

    Seeds, the hashes of ``least`` words from every place of an item, are joined with the documents'. Those of a benchmark of up
    to HELD_WORDS words are sent to every task, and documents are scanned where they lie; those of a larger one are a table.
    Either way documents are read for seeds once.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("item", benchmark.schema[item].dataType),
            T.StructField("tiles", T.IntegerType()),
            T.StructField("matched_words", T.IntegerType()),
            T.StructField("item_words", T.IntegerType()),
            T.StructField("coverage", T.DoubleType()),
            T.StructField("longest", T.IntegerType()),
        ]
    )

    items = _items(benchmark, item)
    seeds = _held(items, least)
    if seeds is None:
        items = cut(items.withColumn("row", F.monotonically_increasing_id()))
        found = _joined(docs, items, least, coverage)
        named = docs.select("doc_id", row_key().alias("key")).join(found, "key").join(items.select("row", "item"), "row")
        return named.select(*schema.names)
    held = docs.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in words.sliced(batch):
                rows = list(_scan(held.value, texts, coverage))
                matched = [sum(x[2] for x in got) for _, _, got, _ in rows]
                columns = [
                    part.column("doc_id").take(pa.array([x[0] for x in rows], pa.int64())),
                    [held.value.ids[x[1]] for x in rows],
                    [len(x[2]) for x in rows],
                    matched,
                    [x[3] for x in rows],
                    [n / x[3] for n, x in zip(matched, rows, strict=True)],
                    [max(y[2] for y in x[2]) for x in rows],
                ]
                kinds = (_arrow(schema["item"]), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
                arrow = pa.schema(
                    [
                        part.schema.field("doc_id"),
                        *(pa.field(f.name, kind) for f, kind in zip(schema.fields[1:], kinds, strict=True)),
                    ]
                )
                yield pa.RecordBatch.from_arrays(
                    [columns[0], *(pa.array(c, f.type) for c, f in zip(columns[1:], list(arrow)[1:], strict=True))],
                    schema=arrow,
                )

    return docs.select("doc_id", "text").mapInArrow(words.frugal(run), schema)


def _arrow(field: T.StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def clean_rows(
    docs: DataFrame, benchmark: DataFrame, item: str = "item_id", least: int = LEAST_TILE, coverage: float = COVERAGE
) -> DataFrame:
    """The rows of ``docs`` that cover no benchmark item, with all their columns. Null texts are clean."""
    items = _items(benchmark, item)
    seeds = _held(items, least)
    if seeds is None:
        found = _joined(docs, cut(items.withColumn("row", F.monotonically_increasing_id())), least, coverage)
        whole = docs.select(row_key().alias("key"), F.struct("*").alias("row"))
        return whole.join(found.select("key").distinct(), "key", "left_anti").select("row.*")
    held = docs.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in words.sliced(batch):
                clean = np.ones(part.num_rows, bool)
                clean[[x[0] for x in _scan(held.value, texts, coverage)]] = False
                yield part.filter(pa.array(clean))

    return docs.mapInArrow(words.frugal(run), docs.schema)
