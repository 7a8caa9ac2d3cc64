"""Sinks for samples and for the outputs of an analysis."""

import os
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from hoplens.functions.series import measured
from hoplens.schema import SERIES, with_keys
from hoplens.sources.folders import children, exists, folder_name, local_path, remove


# Positions of a series that a text file holds at most.
TEXT_BLOCK = 1_000_000


def write_text(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Write samples as result lines under ``run_id=…/target=…``, in the order of ``seq``.

    Each series and block of its positions is one file, so a long series becomes several and no task holds all of it. Files of a write
    are named by the write, and files of one series by the number of the block; a log beside them, ``_writes``, numbers the writes.
    So ``scan_partitioned`` reads what was appended behind what was there. The samples above are computed once.

    There are as many files as series, small ones, so files are what a write costs. They are dealt out to as many tasks as a shuffle has,
    whatever their bytes. On a file system that is a folder of every machine, tasks open and move them by themselves: Hadoop's
    interface to such a folder starts two processes for each file. No write lists the files of those before it, unless one was broken off.
    """
    spark, latency = samples.sparkSession, F.col("latency_ms")
    if mode == "overwrite":
        remove(spark, path)
    before = write_log(spark, path)
    listed = (before is None and exists(spark, path)) or bool(children(spark, f"{path}/{STAGED}"))
    block = F.call_function("div", F.col("seq") - 1, F.lit(TEXT_BLOCK).cast("long"))
    lines = (
        samples.withColumn("block", block)
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *SERIES, "block")
        .sortWithinPartitions(*SERIES, "block", "seq")
        .select(*SERIES, "block", F.coalesce(measured(latency).cast("string"), F.lit("Lost")).alias("value"))
    )
    root = local_path(spark, path) if mode in ("append", "overwrite") else None
    if root is None:
        lines.write.partitionBy(*SERIES, "block").mode(mode).text(path)
        new = _unlogged(spark, path, before)
    else:
        if listed:
            remove(spark, f"{path}/{STAGED}")
        write = str(uuid.uuid4())
        new = [*(_unlogged(spark, path, before) if listed else []), *([write] if _put_files(lines, path, root, write) else [])]
    first = 0 if before is None else before.count()
    rows = [(name, first + number) for number, name in enumerate(new)]
    spark.createDataFrame(rows, WRITES).coalesce(1).write.mode("append").parquet(f"{path}/_writes")
    remove(spark, f"{path}/{STAGED}")


def _unlogged(spark: SparkSession, path: str, before: DataFrame | None) -> list[str]:
    """Writes that the log lacks, by their time: those that ended before they could be logged.

    Which writes there are follows from the files' names; contents are not read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    found = files.select(F.regexp_extract("path", WRITE, 1).alias("write"), "modificationTime")
    new = found.where("write <> ''").groupBy("write").agg(F.min("modificationTime").alias("at"))
    if before is not None:
        new = new.join(before, "write", "left_anti")
    return [row.write for row in new.orderBy("at", "write").collect()]


# Where files stand until all of them are written.
STAGED = "_staged"


def _put_files(lines: DataFrame, path: str, root: str, write: str) -> int:
    """Write sorted lines to a file for each series and block, and move the files in place once all are written. Returns their number.

    Which files a task wrote is stored by Spark's own commit, so those of a task that was run twice are moved once. A file that
    was moved is not moved again.
    """
    staged = f"{root}/{STAGED}/{write}"
    key = itemgetter(0, 1, 2)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        folder = f"{staged}/{task.taskAttemptId()}"
        os.makedirs(folder, exist_ok=True)
        names: list[str] = []
        file, last = None, None
        for batch in batches:
            for place, rows in groupby(zip(*(column.to_pylist() for column in batch.columns)), key):
                if file is None or place != last:
                    if file is not None:
                        file.close()
                    file, last = open(f"{folder}/{len(names)}", "w", encoding="utf-8", newline="\n"), place
                    keys = [f"{name}={folder_name(value)}" for name, value in zip((*SERIES, "block"), place)]
                    # Two keys may be one folder, so the name has a number too.
                    names.append("/".join([*keys, f"part-{task.partitionId():05d}-{write}-c{len(names):03d}.txt"]))
                file.writelines(f"{row[3]}\n" for row in rows)
        if file is not None:
            file.close()
        numbers = [f"{folder}/{number}" for number in range(len(names))]
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.string()), pa.array(names, pa.string())], names=["file", "place"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, place in zip(*(column.to_pylist() for column in batch.columns)):
                whole = f"{root}/{place}"
                os.makedirs(os.path.dirname(whole), exist_ok=True)
                try:
                    os.rename(file, whole)
                except FileNotFoundError:
                    if not os.path.exists(whole):
                        raise
            yield batch

    found = f"{path}/{STAGED}/{write}/files"
    lines.mapInArrow(put, "file string, place string").write.parquet(found)
    return lines.sparkSession.read.schema("file string, place string").parquet(found).mapInArrow(move, "file string, place string").count()


#: The part of a file's name that is the same for all files of one write.
WRITE = r"/part-[0-9]+-([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})[^/]*\z"
WRITES = "write string, number int"


def write_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The writes of a text folder and their order: a row each. None for a folder without a log."""
    log = f"{path.rstrip('/')}/_writes"
    return spark.read.schema(WRITES).parquet(log) if exists(spark, log) else None


# Positions of a series that are written together.
WRITE_BLOCK = 1_000_000


def write_samples(samples: DataFrame, path: str, mode: str = "append", gen: int | None = None) -> None:
    """Store numbered samples as Parquet, clustered by series so that row groups of other targets are skipped.

    Rows are dealt out by series and block of positions, so a long series becomes several files and nothing is sampled.
    ``mode="replace"`` replaces whole runs: those in ``samples``, and no other. With ``gen`` each run gets a folder of that number, and
    writing the same number again replaces that folder alone.
    """
    block = F.call_function("div", F.col("seq"), F.lit(WRITE_BLOCK).cast("long"))
    folders = ["run_id"] if gen is None else ["run_id", "gen"]
    numbered = samples if gen is None else samples.withColumn("gen", F.lit(gen).cast("long"))
    writer = numbered.repartition(*SERIES, block).sortWithinPartitions(*SERIES, "seq").write.partitionBy(*folders)
    if mode == "replace":
        writer = writer.option("partitionOverwriteMode", "dynamic").mode("overwrite")
    else:
        writer = writer.mode(mode)
    writer.parquet(path)


def write_part(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Store a part of a report by run, sorted by segment where it has one, so that a filter on it skips row groups.

    Rebalancing keeps small runs in few files and splits large ones. The layout is the same at any size, so reports of
    any size append to one path.
    """
    keys = ["run_id", *(name for name in ("segment_idx",) if name in rows.columns)]
    together = rows.hint("rebalance", *keys).sortWithinPartitions(*keys)
    together.write.partitionBy("run_id").mode(mode).parquet(path)


def read_segments(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Read an output of ``write_part`` back; filters on run and segment prune folders and row groups."""
    return with_keys(spark.read.schema(schema).parquet(path), ["run_id"])
