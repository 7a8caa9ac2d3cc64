"""Repeated byte strings, found by sorting suffixes bucket by bucket with a difference cover.

A suffix lies in the bucket of the least hashed gram within its first bytes and of that gram's place. Strings that are equal
over the wanted length have the same least gram at the same place, so all equal ones lie in one bucket, and buckets whose
gram occurs once in the corpus need no sorting. Neighbouring suffixes mostly share their gram, so a stretch of text stands
for a run of suffixes. Buckets are sorted a slice of text at a time: suffixes are compared by their first bytes, then by the
rank of a cover sample that both reach within these bytes, then by the last bytes. Cover ranks are computed beforehand, so
a tie costs the same however long it is, and memory is bounded by the slice.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from hoplens.llm import words
from hoplens.llm.common import row_key

#: Bytes that a repeated string has at least.
LENGTH = 200
#: Bytes of a gram; also those compared before the cover ranks.
GRAM = 32
#: A difference cover modulo PERIOD; any two residues reach it by one shift below PERIOD.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Bytes that a cover rank tells apart.
RANKED = 5 * PERIOD
#: Bytes of text whose suffixes are sorted at a time.
SORT_BYTES = 1 << 20
#: Bytes of a text whose grams are hashed at a time.
TILE = 4 << 20
#: Bytes of distinct stretches that a task holds to collect the places of their copies.
HELD_BYTES = 16 << 20
#: What a place counts in it, places of one stretch in a row, and found runs that a task gathers before it passes them on.
PLACE_BYTES, PLACES, OUT_ROWS = 100, 1000, 100_000
#: A gram that occurs more often is hot: its suffixes are dealt out by their whole first bytes instead.
HOT = 20_000

_IN_COVER = np.isin(np.arange(PERIOD), COVER)
SHIFT = np.array(
    [[next(d for d in range(PERIOD) if _IN_COVER[(a + d) % PERIOD] and _IN_COVER[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)],
    np.int64,
)


def _words8(text: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from each position on as a number."""
    number = len(text) - 7
    out = np.empty(max(0, number), np.uint64)
    for shift in range(min(8, len(out))):
        whole = (len(text) - shift) // 8
        out[shift::8] = text[shift : shift + 8 * whole].view(f"{order}u8")[: len(out[shift::8])]
    return out


def _doubled(hashes: np.ndarray, step: int) -> np.ndarray:
    return words.mix(hashes[:-step] * words.STEP + hashes[step:])


def anchors(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of suffixes with the same least gram: (gram, first start, last start, place of the gram)."""
    found = []
    for tile in range(0, len(text) - length + 1, TILE):
        part = text[tile : tile + TILE + length - 1]
        with np.errstate(over="ignore"):
            gram = _doubled(_doubled(_words8(part, "<"), 8), 16)
        # Hash and place in one number, so that the first of equal grams is the least.
        least = (gram & ~np.uint64((1 << 24) - 1)) | np.arange(len(gram), dtype=np.uint64)
        window, width = length - GRAM + 1, 1
        while 2 * width <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < window:
            least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
        place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        found.append((gram[place[first]], first + tile, last + tile, place[first] + tile))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def anchors_of(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """The ``anchors`` of texts that are read in one go, and the row of each; places count from the text's start."""
    sizes = np.array([len(text) for text in texts], np.int64)
    ends = np.cumsum(sizes)
    whole = np.frombuffer(b"".join(texts) or b" ", np.uint8)
    if len(whole) < length:
        return (np.empty(0, np.int64), np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    gram, first, last, place = anchors(whole, length)
    # A string within a text has its least gram there, so a run belongs to the text of its gram.
    row = np.searchsorted(ends, place, "right")
    base = ends[row] - sizes[row]
    first, last = np.maximum(first, base), np.minimum(last, ends[row] - length)
    inside = first <= last
    row, gram, base = row[inside], gram[inside], base[inside]
    return row, gram, first[inside] - base, last[inside] - base, place[inside] - base


def _cover_ranks(words8: np.ndarray) -> np.ndarray:
    """The rank of the RANKED bytes from each cover position on; -1 elsewhere."""
    reach = len(words8) - RANKED
    ranks = np.full(len(words8), -1, np.int64)
    at = np.flatnonzero(_IN_COVER[np.arange(len(words8)) % PERIOD][: max(0, len(words8) - 24)])

    def dense(at: np.ndarray, *keys: np.ndarray) -> np.ndarray:
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(at), bool)
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        out = np.empty(len(at), np.int64)
        out[order] = np.cumsum(new)
        return out

    # PERIOD bytes: four overlapping words, 7 bytes apart at the end.
    one = ranks.copy()
    one[at] = dense(at, words8[at], words8[at + 8], words8[at + 16], words8[at + PERIOD - 8])
    step = one
    for width in (1, 2):
        at = at[at + width * PERIOD < len(words8)]
        at = at[step[at + width * PERIOD] >= 0]
        wider = ranks.copy()
        wider[at] = dense(at, step[at], step[at + width * PERIOD])
        step = wider
    at = at[at + 4 * PERIOD < len(words8)]
    at = at[one[at + 4 * PERIOD] >= 0]
    ranks[at] = dense(at, step[at], one[at + 4 * PERIOD])
    ranks[max(0, reach + 8) :] = -1
    return ranks


def repeated_suffixes(text: np.ndarray, starts: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """Which of the suffixes at ``starts`` share their first ``length`` bytes with another of their bucket.

    Each bucket is sorted by three-way splits around one of its suffixes, all buckets in step.
    """
    text = np.concatenate([text, np.zeros(GRAM, np.uint8)])
    eight = _words8(text, ">")
    ranks = _cover_ranks(eight)
    head = np.array([0, 8, 16, GRAM - 8])
    tail = np.append(np.arange(RANKED, length - 8, 8), length - 8)
    repeated = np.zeros(len(starts), bool)
    active = np.argsort(bucket, kind="stable")
    group = bucket[active]
    while len(active):
        new = np.concatenate([[True], group[1:] != group[:-1]])
        number = np.cumsum(new) - 1
        size = np.bincount(number)
        keep = size[number] > 1
        active, number, new = active[keep], number[keep], new[keep]
        if not len(active):
            break
        number = np.cumsum(new) - 1
        own, pivot = starts[active], starts[active[np.flatnonzero(new)]][number]
        order = np.zeros(len(active), np.int8)
        open_ = np.arange(len(active))

        def compare(left: np.ndarray, right: np.ndarray) -> None:
            nonlocal open_
            order[open_] = np.where(left < right, -1, np.where(left > right, 1, 0))
            open_ = open_[left == right]

        for place in head:
            compare(eight[own[open_] + place], eight[pivot[open_] + place])
        shift = SHIFT[own[open_] % PERIOD, pivot[open_] % PERIOD]
        compare(ranks[own[open_] + shift], ranks[pivot[open_] + shift])
        for place in tail:
            compare(eight[own[open_] + place], eight[pivot[open_] + place])
        equal = order == 0
        alike = np.bincount(number[equal], minlength=number[-1] + 1)
        repeated[active[equal & (alike[number] > 1)]] = True
        rest = ~equal
        # The lesser and the greater part of each group, next to each other.
        group = (2 * number + (order > 0))[rest]
        active = active[rest]
        by = np.argsort(group, kind="stable")
        active, group = active[by], group[by]
    return repeated


_AT = T.StructType([T.StructField("gram", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("place", T.IntegerType())])


def _grams(rows: DataFrame, length: int, located: bool) -> DataFrame:
    """Least grams: with how often each batch has them, or where each row has them."""
    schema = T.StructType([rows.schema["key"], *_AT.fields]) if located else T.StructType([_AT["gram"], T.StructField("n", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in words.sliced(batch):
                row, gram, first, last, place = anchors_of(texts, length)
                if located:
                    columns = [part.column("key").take(pa.array(row)), pa.array(gram.view(np.int64))]
                    columns += [pa.array(x.astype(np.int32)) for x in (first, last, place)]
                else:
                    gram, n = np.unique(gram, return_counts=True)
                    columns = [pa.array(gram.view(np.int64)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.select("key", "text").mapInArrow(words.frugal(read), schema)


def _stretches(near: DataFrame, length: int) -> DataFrame:
    """A row for each distinct stretch of HELD_BYTES, with where it occurs; hot stretches suffix by suffix, without text.

    A stretch that occurs more than once there is known to be repeated: its row has no place, and ``n`` of 2. Its places go on
    in rows of their own, ``n`` of 0, whose buckets are spread, so however often a string occurs, no task gets all its places.
    """
    schema = "bucket long, digest binary, n long, places binary, starts int, lead int, text binary"

    def taken(held: dict[bytes, list]) -> pa.RecordBatch:
        rows = []
        for bucket, digest, where, starts, lead, text in held.values():
            if len(where) == 1:
                rows.append((bucket, digest, 1, where[0], starts, lead, text))
                continue
            rows.append((bucket, digest, 2, b"", starts, lead, text))
            for i in range(0, len(where), PLACES):
                spread = xxhash.xxh3_64_intdigest(digest + where[i]) - (1 << 63)
                rows.append((spread, b"", 0, b"".join(where[i : i + PLACES]), starts, 0, b""))
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
        columns = zip(*rows) if rows else ((),) * len(kinds)
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)],
            names=["bucket", "digest", "n", "places", "starts", "lead", "text"],
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0
        for batch in batches:
            for part, texts in words.sliced(batch):
                keys = part.column("key").to_pylist()
                lists = part.column("at")
                ends = np.cumsum(lists.value_lengths().to_numpy()).tolist()
                fields = zip(*(field.to_pylist() for field in lists.flatten().flatten()), strict=True)
                places = list(fields)
                for i, text in enumerate(texts):
                    for gram, first, last, place, hot in set(places[ends[i - 1] if i else 0 : ends[i]]):
                        for start, end in [(s, s) for s in range(first, last + 1)] if hot else [(first, last)]:
                            own = text[start : end + length]
                            digest = xxhash.xxh3_128_digest(own)
                            where = keys[i] + start.to_bytes(4, "little")
                            size += PLACE_BYTES
                            if digest in held:
                                held[digest][2].append(where)
                            else:
                                bucket = int.from_bytes(digest[:8], "big", signed=True) if hot else gram
                                held[digest] = [bucket, digest, [where], end - start + 1, place - start, b"" if hot else own]
                                size += len(own)
                if size >= HELD_BYTES:
                    yield taken(held)
                    held, size = {}, 0
        yield taken(held)

    return near.select("key", "doc_id", "text", "at").mapInArrow(words.frugal(read), schema)


_KEY = 16  # bytes of a row's key


class _Sorter:
    """Takes stretches by bucket and digest, and gives the repeated suffixes: (key, start, number)."""

    def __init__(self, length: int):
        self.length = length
        self.bucket: int | None = None
        self.last: list | None = None  # the stretch whose copies may still follow
        self.own: list[list] = []  # the bucket's distinct stretches
        self.held: list[list] = []  # those of earlier buckets that are to be sorted
        self.bytes = 0
        self.out: list[tuple[bytes, int, int]] = []

    def _emit(self, places: bytes, runs: list[tuple[int, int]]) -> None:
        for i in range(0, len(places), _KEY + 4):
            start = int.from_bytes(places[i + _KEY : i + _KEY + 4], "little")
            self.out += [(places[i : i + _KEY], start + first, number) for first, number in runs]

    def add(self, bucket: int, digest: bytes, n: int, places: bytes, starts: int, lead: int, text: bytes) -> None:
        if not n:
            self._emit(places, [(0, starts)])
            return
        if bucket != self.bucket:
            self._close()
            self.bucket = bucket
        if self.last and self.last[0] == digest:
            # All suffixes of a stretch that occurs again are repeated, so its places needn't be kept.
            if self.last[1]:
                self._emit(self.last[1], [(0, starts)])
                self.last[1] = b""
            self._emit(places, [(0, starts)])
            return
        self.last = [digest, places, starts, lead, text, len(self.own)]
        self.own.append(self.last)

    def _close(self) -> None:
        if len(self.own) > 1 and any(x[1] for x in self.own):
            number = len(self.held)
            self.held += [[number, *x[1:5]] for x in self.own if x[4]]
            self.bytes += sum(len(x[4]) for x in self.own)
        self.own, self.last = [], None
        if self.bytes >= SORT_BYTES:
            self.sort()

    def sort(self) -> None:
        """Sort the held buckets."""
        held, self.held, self.bytes = self.held, [], 0
        if not held:
            return
        text = np.frombuffer(b"".join(x[4] for x in held), np.uint8)
        sizes = np.array([len(x[4]) for x in held])
        starts = np.array([x[2] for x in held])
        base = np.cumsum(sizes) - sizes
        within = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
        # The gram's place in the suffix is part of its bucket.
        bucket = np.repeat([x[0] * self.length for x in held], starts) + np.repeat([x[3] for x in held], starts) - within
        found = repeated_suffixes(text, np.repeat(base, starts) + within, bucket, self.length)
        at = 0
        for x, number in zip(held, starts, strict=True):
            own = found[at : at + number]
            at += number
            if x[1] and own.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                self._emit(x[1], [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)])

    def finish(self) -> None:
        self._close()
        self.sort()

    def taken(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.binary()), *(pa.array([x[k] for x in out], pa.int32()) for k in (1, 2))],
            names=["key", "start", "number"],
        )


def _sorted(stretches: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorter = _Sorter(length)
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                sorter.add(*row)
                if len(sorter.out) >= OUT_ROWS:
                    yield sorter.taken()
        yield sorter.taken()
        sorter.finish()
        yield sorter.taken()

    dealt = stretches.repartition("bucket").sortWithinPartitions("bucket", "digest")
    return dealt.mapInArrow(words.frugal(run), "key binary, start int, number int")


def _cut(rows: DataFrame, length: int) -> DataFrame:
    """Removes from each text the bytes that its repeated suffixes' first bytes cover."""
    schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("n_bytes", T.LongType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
            T.StructField("kept", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in words.sliced(batch):
                spans, kept = [], []
                for text, found in zip(texts, part.column("found").to_pylist(), strict=True):
                    own: list[dict] = []
                    for start, number in sorted((x["start"], x["number"]) for x in found or ()):
                        end = start + number - 1 + length
                        if own and start <= own[-1]["end"]:
                            own[-1]["end"] = max(own[-1]["end"], end)
                        else:
                            own.append({"start": start, "end": end})
                    ends = [0, *(x["end"] for x in own)]
                    kept.append(b"".join(text[a:b] for a, b in zip(ends, [*(x["start"] for x in own), len(text)], strict=True)))
                    spans.append(own)
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(text) for text in texts], pa.int64()),
                        pa.array(spans, kind),
                        pa.array(kept, pa.binary()),
                    ],
                    names=schema.names,
                )

    return rows.select("doc_id", "text", "found").mapInArrow(words.frugal(run), schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Removes every byte that a string of ``length`` bytes covers which also starts anywhere else.

    Strings are judged on the UTF-8 bytes of the input's texts, within and across documents, never over a text's end. Returns
    one row per row of ``docs``: ``doc_id, n_bytes, spans`` (removed runs as start and end in bytes) and ``kept`` (the other
    bytes; a character may lose some of its). A null text is empty; rows that repeat repeat each other's strings; texts
    shorter than ``length`` keep all; other columns are not read. An empty table gives no rows.

    ``length`` is RANKED + GRAM at least. What the sort and the cover's ranks decide are strings in stretches of text that differ. Two
    shares don't pass it: whole stretches that are equal, by a 128-bit digest of their bytes, and grams that occur more than
    ``hot`` times, whose suffixes are dealt out and told apart by the digest of their ``length`` bytes, so that no bucket grows
    without bound. A text's repeated strings are gathered in one row, some 16 bytes for each run, or for each string where a
    gram is hot; so a text with hot grams throughout may have 100 MB.
    """
    if length < RANKED + GRAM:
        raise ValueError(f"length must be {RANKED + GRAM} or more")
    # The same columns and no null key, so that both joins below read one shuffle of the texts.
    rows = docs.select(F.coalesce(F.unhex(row_key()), F.lit(b"")).alias("key"), "doc_id", "text")
    counts = _grams(rows, length, False).groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    places = (
        _grams(rows, length, True)
        .join(counts, "gram")
        .groupBy("key")
        .agg(F.collect_list(F.struct("gram", "first", "last", "place", (F.col("n") > hot).alias("hot"))).alias("at"))
    )
    found = _sorted(_stretches(rows.join(places, "key"), length), length)
    by_row = found.groupBy("key").agg(F.collect_set(F.struct("start", "number")).alias("found"))
    return _cut(rows.join(by_row, "key", "left"), length)
