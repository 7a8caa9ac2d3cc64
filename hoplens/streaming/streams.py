"""Streams of samples: sources, the sink, and how a query is driven."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from hoplens.functions.parsing import decoded_path, parse_lines, run_from_path, target_from_path
from hoplens.operators.keys import join_keys
from hoplens.operators.numbering import with_seq
from hoplens.schema import EVENTS, SAMPLES, SERIES, with_keys
from hoplens.session import scratch_path
from hoplens.sources import updates
from hoplens.sources.folders import remove
from hoplens.sources.sinks import write_samples
from hoplens.sources.text import RESULT_FILES, all_files, folder_keys
from hoplens.sources.updates import newest

REFRESH = "500 milliseconds"


def _files(spark: SparkSession, max_files: int | None):
    reader = spark.readStream
    return reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)


def sample_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Canonical samples landing as Parquet. The source takes new files, so producers land small ones."""
    return with_keys(_files(spark, max_files).schema(SAMPLES).parquet(path), ["run_id"])


def event_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    return _files(spark, max_files).schema(EVENTS).parquet(path)


def result_stream(spark: SparkSession, folders: str, max_files: int | None = None) -> DataFrame:
    """Lines of result files as they land in run folders. A stream of lines carries no positions."""
    path = decoded_path(F.col("_metadata.file_path"))
    lines = _files(spark, max_files).option("pathGlobFilter", RESULT_FILES).text(folders)
    return parse_lines(
        lines.select(
            run_from_path(path).alias("run_id"), target_from_path(path).alias("target"), "value"
        )
    )


def partitioned_stream(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """Lines of a partitioned text folder as its files land."""
    keys = folder_keys(F.col("_metadata.file_path"))
    lines = all_files(_files(spark, max_files), root).select(*(key.alias(name) for name, key in keys.items()), "value")
    return parse_lines(with_keys(lines, SERIES).select(*SERIES, "value"))


def store(
    stream: DataFrame, path: str, checkpoint: str | None = None, partition_by: list[str] | None = None,
    every: str | None = REFRESH,
) -> StreamingQuery:
    """Append a stream to Parquet, exactly once: the file sink logs each batch and offsets are checkpointed.

    ``every`` paces the refresh; None takes what there is now and stops, as a scheduled job does.
    """
    writer: DataStreamWriter = stream.writeStream.format("parquet").outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    checkpoint = checkpoint or scratch_path(stream.sparkSession, "stream-checkpoint")
    return writer.option("checkpointLocation", checkpoint).start(path)


def _each_batch(
    stream: DataFrame, put: Callable[[DataFrame, int], None], mode: str, checkpoint: str | None, every: str | None
) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(put)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    checkpoint = checkpoint or scratch_path(stream.sparkSession, "stream-checkpoint")
    return writer.option("checkpointLocation", checkpoint).start()


def store_updates(
    stream: DataFrame,
    path: str,
    checkpoint: str | None = None,
    every: str | None = REFRESH,
    merged_by: tuple[list[str], str] | None = None,
    merge_every: int = 20,
) -> StreamingQuery:
    """Store the rows that each batch updates, a folder ``batch=…`` for each; a batch that is run again replaces its own.

    With ``merged_by``, keys and a version that only grows, all that is newest is merged after every ``merge_every`` batches. Then
    ``updates.read_newest`` opens that many folders at most, and the log takes no more room than its keys and the batches
    of two merges.
    """
    schema = stream.schema

    def put(batch: DataFrame, number: int) -> None:
        if merged_by is not None and number and number % merge_every == 0:
            updates.merge(batch.sparkSession, path, schema, *merged_by, upto=number - 1)
        updates.put(batch, path, number)

    return _each_batch(stream, put, "update", checkpoint, every)


#: The numbers of lines that a table has of each series.
LINES = "run_id string, target string, lines bigint, gen bigint"


def store_appended(
    stream: DataFrame, path: str, checkpoint: str | None = None, every: str | None = REFRESH, merge_every: int = 20
) -> StreamingQuery:
    """Number the lines of an ``appended_stream`` and store them as samples, exactly once.

    A batch continues each series from the number of its lines so far, which a log beside the samples keeps. Samples and log of a batch
    have its number, so a batch that is run again replaces what it had written. ``read_samples`` reads the table.
    """
    log = f"{path}/_lines"

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        remove(spark, f"{log}/batch={number}")
        if number and number % merge_every == 0:
            updates.merge(spark, log, LINES, SERIES, "gen", upto=number - 1)
        before = updates.read_newest(spark, log, LINES, SERIES, "gen", upto=number - 1)
        numbered = join_keys(with_seq(batch, ["at"]), before.select(*SERIES, "lines"), SERIES, "left")
        seq = F.col("seq") + F.coalesce("lines", F.lit(0))
        rows = numbered.select(*SERIES, seq.alias("seq"), "latency_ms", "malformed")
        write_samples(rows, path, mode="replace", gen=number)
        stored = spark.read.schema("target string, seq bigint, run_id string, gen bigint").parquet(path).where(F.col("gen") == number)
        lines = with_keys(stored, SERIES).groupBy(*SERIES).agg(F.max("seq").alias("lines"))
        updates.put(lines.withColumn("gen", F.lit(number).cast("long")), log, number)

    return _each_batch(stream, put, "append", checkpoint, every)


def store_samples(stream: DataFrame, path: str, **options) -> StreamingQuery:
    """Store samples by run and day. A folder per target would make a file per target and batch."""
    return store(
        stream.withColumn("day", F.to_date("ts")), path, partition_by=["run_id", "day"], **options
    )


def run_to_end(query: StreamingQuery) -> None:
    """Wait for a query started with ``every=None``; errors of the query surface here."""
    query.awaitTermination()
