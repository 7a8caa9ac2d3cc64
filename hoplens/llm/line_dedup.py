"""Runs of lines that repeat, found by winnowing over line hashes.

Fingerprints that occur more than once are seeds. Around each, the shortest runs of enough words are positions to be joined: a later
one with the first that has the same lines. From there a match is extended both ways, as far as the lines of both texts are equal.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from hoplens.llm import words
from hoplens.llm.common import cut, row_key

#: A run is deleted from this many words on.
LEAST_WORDS = 50
#: Lines in a winnowing window. At 2, every run of two lines holds a fingerprint; longer single lines are one themselves.
WINDOW = 2
_HASH = 16  # bytes of a line's hash


def fingerprints(hashes: np.ndarray, lengths: np.ndarray, window: int, least_words: int) -> np.ndarray:
    """Positions of the smallest hash, the last of equal ones, in each window of lines; and lines that are a run alone."""
    picked = set(np.flatnonzero(lengths >= least_words).tolist())
    for first in range(max(0, len(hashes) - window + 1)):
        part = hashes[first : first + window]
        picked.add(first + len(part) - 1 - int(np.argmin(part[::-1])))
    return np.array(sorted(picked), np.int64)


def least_runs(lengths: np.ndarray, seeds: np.ndarray, least_words: int) -> list[tuple[int, int]]:
    """Shortest runs (first, last) of enough words around seeds: from each line on, and up to each line.

    A match of enough words holds one of them at least, and so meets the first place that has its lines, whatever other places share
    its fingerprints.
    """
    total = np.concatenate([[0], np.cumsum(lengths)])
    first = np.arange(len(lengths))
    ends = np.searchsorted(total, total[:-1] + least_words, "left") - 1
    starts = np.searchsorted(total, total[1:] - least_words, "right") - 1
    ahead = [(int(a), int(b)) for a, b in zip(first, ends, strict=True) if b < len(lengths)]
    back = [(int(a), int(b)) for a, b in zip(starts, first, strict=True) if a >= 0]
    held = np.concatenate([[0], np.cumsum(np.isin(first, seeds))])
    return sorted({(a, b) for a, b in ahead + back if held[b + 1] > held[a]})


def _lines(docs: DataFrame, window: int, least_words: int) -> DataFrame:
    """Of each row: hashes and words of its lines that aren't blank, their numbers, and the fingerprints."""
    rows = docs.select("doc_id", row_key().alias("key"), "text")
    schema = T.StructType(
        [
            *rows.schema.fields[:2],
            T.StructField("hashes", T.BinaryType()),
            T.StructField("lengths", T.ArrayType(T.IntegerType())),
            T.StructField("numbers", T.ArrayType(T.IntegerType())),
            T.StructField("picks", T.ArrayType(T.IntegerType())),
            T.StructField("prints", T.ArrayType(T.LongType())),
        ]
    )
    kinds = (pa.binary(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.int64()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in words.sliced(batch):
                out = []
                for text in texts:
                    lines = [(i, line.strip()) for i, line in enumerate(text.split(b"\n")) if line.strip()]
                    hashes = b"".join(xxhash.xxh3_128_digest(line) for _, line in lines)
                    lengths = np.array([len(line.split()) for _, line in lines], np.int32)
                    values = np.frombuffer(hashes, "<i8").reshape(-1, 2)[:, 0]
                    picks = fingerprints(values, lengths, window, least_words)
                    out.append((hashes, lengths, [i for i, _ in lines], picks, values[picks]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))],
                    names=schema.names,
                )

    return rows.mapInArrow(words.frugal(read), schema)


def _least_runs(near: DataFrame, least_words: int) -> DataFrame:
    """A row for each shortest run around the seeds, with the digest of its lines."""
    schema = T.StructType(
        [
            *near.select("doc_id", "key").schema.fields,
            T.StructField("digest", T.BinaryType()),
            T.StructField("first", T.IntegerType()),
            T.StructField("last", T.IntegerType()),
        ]
    )

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            columns = [batch.column(name) for name in ("hashes", "lengths", "seeds")]
            for i in range(batch.num_rows):
                hashes, lengths, seeds = (column[i].as_py() for column in columns)
                for first, last in least_runs(np.array(lengths, np.int64), np.array(seeds), least_words):
                    row.append(i)
                    out.append((xxhash.xxh3_128_digest(hashes[first * _HASH : (last + 1) * _HASH]), first, last))
            where = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(where),
                    batch.column("key").take(where),
                    *(pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.binary(), pa.int32(), pa.int32()))),
                ],
                names=schema.names,
            )

    return near.mapInArrow(words.frugal(runs), schema)


def extended(hashes: bytes, there: bytes, shift: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Matches of a text's lines with those of another that stand ``shift`` lines further there, as far as lines are equal."""
    own, other = (np.frombuffer(x, "<u8").reshape(-1, 2) for x in (hashes, there))
    first, last = max(0, -shift), min(len(own), len(other) - shift)
    differ = np.flatnonzero((own[first:last] != other[first + shift : last + shift]).any(1)) + first
    borders = np.concatenate([[first - 1], differ, [last]])
    at = np.array(sorted(spans), np.int64)
    before = np.searchsorted(borders, at[:, 0], "right") - 1
    # A span of the first place's digest has equal lines; one that had not would hold a line that differs.
    whole = borders[before + 1] > at[:, 1]
    return sorted({(int(borders[k]) + 1, int(borders[k + 1]) - 1) for k in before[whole]})


def _extended(matches: DataFrame, lines: DataFrame) -> DataFrame:
    """``key, first, last, earlier`` of matches, extended both ways: one row for all positions of a match."""
    shift = (F.col("origin.first") - F.col("first")).alias("shift")
    met = matches.groupBy("key", F.col("origin.key").alias("other"), shift).agg(
        F.first("origin.doc_id").alias("earlier"), F.collect_list(F.struct("first", "last")).alias("spans")
    )
    there = lines.select(F.col("key").alias("other"), F.col("hashes").alias("there"))
    both = met.join(lines.select("key", "hashes"), "key").join(there, "other")
    schema = T.StructType(
        [met.schema["key"], T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), met.schema["earlier"]]
    )

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            columns = [batch.column(name) for name in ("hashes", "there", "shift", "spans")]
            for i in range(batch.num_rows):
                hashes, there, shift, spans = (column[i].as_py() for column in columns)
                own = extended(hashes, there, shift, [(span["first"], span["last"]) for span in spans])
                row += [i] * len(own)
                found += own
            where = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(where),
                    *(pa.array([x[k] for x in found], pa.int32()) for k in (0, 1)),
                    batch.column("earlier").take(where),
                ],
                names=schema.names,
            )

    return both.select("key", "earlier", "shift", "spans", "hashes", "there").mapInArrow(words.frugal(extend), schema)


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS, window: int = WINDOW) -> DataFrame:
    """Runs of lines that occur earlier, which are to be deleted.

    Lines are split at line feeds and compared without white space around them; blank lines don't count. Where a run of
    ``least_words`` words or more occurs several times, in one text or many, the first by ``doc_id`` and line stays and the
    later ones are returned: ``doc_id, key, first_line, last_line, words, earlier_doc_id``. Lines are numbered from 0;
    ``earlier_doc_id`` has the first occurrence of the run's beginning. Every deleted line has an equal one that stays.
    ``key`` is a digest of ``doc_id`` and text: rows equal in both are one document and share their runs. Null and empty texts
    have no runs; a null ``doc_id`` comes first; other columns are not read. An empty table gives no rows.

    Fingerprints that occur once are dropped after adding up by hash. Around the others, the shortest runs of enough words
    are joined with the first run of the same digest, so a line that a third of all texts hold makes no pairs. Matches are
    extended both ways on the lines of both texts, whose hashes are 128 bits.
    """
    lines = cut(_lines(docs, window, least_words).dropDuplicates(["key"]))
    prints = lines.select("key", F.explode(F.arrays_zip("picks", "prints")).alias("at")).select(
        "key", F.col("at.picks").alias("pick"), F.col("at.prints").alias("print")
    )
    repeated = prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    seeds = prints.join(repeated, "print").groupBy("key").agg(F.collect_list("pick").alias("seeds"))
    runs = cut(_least_runs(lines.join(seeds, "key").select("doc_id", "key", "hashes", "lengths", "seeds"), least_words))
    at = F.struct("doc_id", "key", "first")
    origins = runs.groupBy("digest").agg(F.min(at).alias("origin"), F.count("*").alias("n")).where("n > 1")
    matches = (
        runs.join(origins.select("digest", "origin"), "digest")
        .where((F.col("key") != F.col("origin.key")) | (F.col("first") != F.col("origin.first")))
        .select("key", "first", "last", "origin")
    )
    # The shortest runs tell where a match's beginning occurred first; what the others have joined may be elsewhere.
    parts = matches.select("key", "first", "last", F.col("origin.doc_id").alias("earlier")).unionAll(_extended(matches, lines))
    later = parts.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("first", "last", "earlier"))).alias("parts"))
    # Runs that touch or overlap are one; a document's runs lie in one row.
    start = F.array().cast(later.schema["parts"].dataType)

    def join(runs: Column, part: Column) -> Column:
        end = F.element_at(runs, -1)
        longer = F.struct(end["first"].alias("first"), F.greatest(end["last"], part["last"]).alias("last"), end["earlier"].alias("earlier"))
        touches = (F.size(runs) > 0) & (part["first"] <= F.try_element_at(runs, F.lit(-1))["last"] + 1)
        return F.when(touches, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer))).otherwise(
            F.concat(runs, F.array(part))
        )

    merged = later.select("key", F.explode(F.aggregate("parts", start, join)).alias("run"))
    number = lambda place: F.element_at("numbers", place + 1)
    return (
        merged.join(lines.select("doc_id", "key", "lengths", "numbers"), "key")
        .select(
            "doc_id",
            "key",
            number(F.col("run.first")).alias("first_line"),
            number(F.col("run.last")).alias("last_line"),
            F.aggregate(
                F.slice("lengths", F.col("run.first") + 1, F.col("run.last") - F.col("run.first") + 1),
                F.lit(0),
                lambda total, n: total + n,
            ).alias("words"),
            F.col("run.earlier").alias("earlier_doc_id"),
        )
    )


def drop_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with later repeated runs deleted from their texts; other columns and null texts are unchanged."""
    runs = repeated_runs(docs, least_words, window).groupBy("key").agg(F.collect_list(F.struct("first_line", "last_line")).alias("runs"))
    whole = docs.select(row_key().alias("key"), F.struct("*").alias("row")).join(runs, "key", "left")
    stays = lambda i: ~F.exists("runs", lambda run: (i >= run["first_line"]) & (i <= run["last_line"]))
    text = F.array_join(F.filter(F.split("row.text", "\n"), lambda line, i: stays(i)), "\n")
    return whole.select(F.col("row").withField("text", F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(text)).alias("row")).select("row.*")
