"""Exact deduplication by a stream with keyed state."""

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hoplens.llm.common import cut, lower_ascii, measured, whole_text
from hoplens.session import scratch_path

# Spark's state store on local disks, with changes stored in the checkpoint.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    # MB that all stores of an executor share; what is read again is on its disk.
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    # No files of megabytes set aside for each small partition of the state.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # A partition's store is closed with its task, so an executor holds as many as it runs tasks.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Up to so many digests with hits are sent to every task to pick their rows; beyond, those rows are found by a shuffle.
FEW_HITS = 2_000_000


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _located(
    docs: DataFrame, digest: Callable[[Column], Column] | None, content: Column, sha: Column | None = None
) -> DataFrame:
    """Content locator of every row, which is the file, by its hash, and the row in the file; and digest or content."""
    at = docs.metadataColumn("_metadata")
    told = [content.alias("content")] if digest is None else [digest(content).alias("digest")]
    return docs.select(
        F.col("doc_id"),
        F.xxhash64(at["file_path"]).alias("file"),
        at["row_index"].alias("place"),
        *told,
        *([] if sha is None else [sha.alias("text_sha256")]),
    )


def absorb(
    spark: SparkSession,
    path: str,
    checkpoint: str,
    digest: Callable[[Column], Column] = sha256,
    files: int | None = None,
) -> None:
    """Stream what is new at ``path`` into the state kept at ``checkpoint``, and stop.

    State is keyed by digest and never expires. It lies in RocksDB on the executors' disks and is restored from the
    checkpoint, so an executor may be lost, and a later call goes on from where this one ended. Each digest retains the
    largest ``doc_id``, the locator of that row's content and the number of rows. Rows of one digest are added up in each
    task before the shuffle. ``files`` bounds the files of one batch.
    """
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    # A pattern of one name, since a stream takes a single file only by a pattern.
    path = path.rstrip("/")
    rows = _located(reader.parquet(f"{path[:-1]}[{path[-1]}]"), digest, lower_ascii(whole_text()))
    # Of rows that repeat a doc_id, the one with the larger locator stands for the group.
    state = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "place")), F.count("*"))
    with _settings(spark, STATE):
        query = (
            state.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as a table: ``digest, last (doc_id, file, place), group_size``."""
    with _settings(spark, STATE):
        stored = spark.read.format("statestore").load(checkpoint)
    return stored.select(
        F.col("key.digest").alias("digest"), F.col("value.max").alias("last"), F.col("value.count").alias("group_size")
    )


def dedupe_table(
    spark: SparkSession,
    path: str,
    checkpoint: str | None = None,
    digest: Callable[[Column], Column] = sha256,
    files: int | None = None,
    few_hits: int = FEW_HITS,
) -> DataFrame:
    """Groups of rows with equal texts of the Parquet table at ``path``.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Returns one row per row of the table:
    ``doc_id, keep_id, group_size, kept, text_sha256, file, place``. Of each group the row with the largest ``doc_id`` stays
    (a null is the smallest; of rows that repeat it, the one with the larger locator). Other columns are not read. An empty
    table gives no rows. Without ``checkpoint`` the state is kept in the shared folder under a new name.

    A digest that occurs again is only a hit: each such row's full text is compared with the text at the retained locator.
    Rows that differ from it are grouped anew by digest and full text, so the result holds for any digest.
    """
    checkpoint = checkpoint or scratch_path(spark, "exact-dedup")
    absorb(spark, path, checkpoint, digest, files)
    state = cut(read_state(spark, checkpoint))
    docs = spark.read.parquet(path)
    content = lower_ascii(whole_text(F.col("text")))
    rows = cut(
        _located(docs, digest, content, None if digest is sha256 else sha256(content)).join(state, "digest")
    )

    # Only rows with a hit are read again, by their locators.
    hits = rows.where(F.col("group_size") > 1).select("file", "place", "digest", _is_last().alias("retained"), "doc_id")
    few = measured(hits.select("file", "place"), few_hits)
    texts = _located(docs, None, content).join(few, ["file", "place"], "left_semi").select("file", "place", "content")
    repeated = hits.join(texts, ["file", "place"])
    kept = repeated.where("retained").select("digest", F.col("content").alias("own"))
    differing = cut(
        repeated.where("NOT retained")
        .join(kept, "digest")
        .where(F.col("content") != F.col("own"))
        .select("doc_id", "digest", "file", "place", "content")
    )

    told = rows if differing.isEmpty() else _apart(rows, differing)
    sha = F.col("digest" if digest is sha256 else "text_sha256").alias("text_sha256")
    return told.select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", _is_last().alias("kept"), sha, "file", "place"
    )


def _is_last() -> Column:
    """Whether the row is the one at its group's locator."""
    return (F.col("file") == F.col("last.file")) & (F.col("place") == F.col("last.place"))


def _apart(told: DataFrame, differing: DataFrame) -> DataFrame:
    """Groups where texts share a digest: rows that differ from the retained text leave its group for their own."""
    left = differing.groupBy("digest").agg(F.count("*").alias("gone"))
    groups = differing.groupBy("digest", "content").agg(
        F.max(F.struct("doc_id", "file", "place")).alias("own_last"), F.count("*").alias("own_size")
    )
    own = differing.join(groups, ["digest", "content"]).select("file", "place", "own_last", "own_size")
    return (
        told.join(left, "digest", "left")
        .join(own, ["file", "place"], "left")
        .withColumn("last", F.coalesce("own_last", "last"))
        .withColumn("group_size", F.coalesce("own_size", F.col("group_size") - F.coalesce("gone", F.lit(0))))
    )


def unique_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. The rows are stored first, since a stream reads files."""
    spark = docs.sparkSession
    path = scratch_path(spark, "exact-dedup-rows")
    docs.write.parquet(path)
    stored = spark.read.schema(docs.schema).parquet(path)
    at = stored.metadataColumn("_metadata")
    placed = stored.select(
        F.struct(*(stored[name] for name in stored.columns)).alias("row"),
        F.xxhash64(at["file_path"]).alias("file"),
        at["row_index"].alias("place"),
    )
    gone = cut(dedupe_table(spark, path, **options).where(~F.col("kept")).select("file", "place"))
    return placed.join(measured(gone, FEW_HITS), ["file", "place"], "left_anti").select("row.*")
