"""A log of updates: rows that replace earlier ones of the same key.

Each batch is a folder ``batch=N``. From time to time all that is newest is merged into a folder ``generation=N``, which stands for batch N
and all before it. Readers take the last whole generation and the batches after it, so what they open does not grow with the
number of batches. A generation counts once Spark has marked it as written, so a merge that was broken off changes nothing. Folders
that a generation replaces are removed one merge later, so that a reader that began before it may end.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from hoplens.sources.folders import children, exists, remove


def put(rows: DataFrame, path: str, number: int) -> None:
    """Add a batch. One that is put again replaces its first version."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def newest(updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last update of each key, by a version that only grows. A key may be NULL."""
    rest = [name for name in updates.columns if name not in keys]
    latest = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("latest"))
    return latest.select(*keys, "latest.*")


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the folders of a kind that were written to their end."""
    found = [int(name.partition("=")[2]) for name in children(spark, path) if name.startswith(f"{kind}=")]
    return sorted(number for number in found if exists(spark, f"{path}/{kind}={number}/_SUCCESS"))


def state_folders(spark: SparkSession, path: str, upto: int | None = None) -> list[str]:
    """The folders that hold the state after batch ``upto`` (by default the last): a generation, if there is one, and the batches
    after it."""
    last = [number for number in _numbers(spark, path, "generation") if upto is None or number <= upto][-1:]
    later = [
        number
        for number in _numbers(spark, path, "batch")
        if (not last or number > last[0]) and (upto is None or number <= upto)
    ]
    return [f"{path}/generation={number}" for number in last] + [f"{path}/batch={number}" for number in later]


def last_batch(spark: SparkSession, path: str) -> int:
    """Number of the last batch or generation; -1 in an empty log."""
    return max([-1, *_numbers(spark, path, "generation"), *_numbers(spark, path, "batch")])


def read_newest(
    spark: SparkSession, path: str, schema: StructType | str, keys: list[str], version: str, upto: int | None = None
) -> DataFrame:
    """The newest row of each key; none in an empty log."""
    folders = state_folders(spark, path, upto)
    if not folders:
        return spark.createDataFrame([], schema)
    # Folders are read by their own names, so their numbers do not become a column.
    return newest(spark.read.schema(schema).parquet(*folders), keys, version)


def merge(
    spark: SparkSession, path: str, schema: StructType | str, keys: list[str], version: str, upto: int | None = None
) -> None:
    """Write the next generation, of batches to ``upto``, and remove what the generation before it had replaced.

    A query that may run its last batch again merges up to the batch before.
    """
    before = _numbers(spark, path, "generation")
    number = last_batch(spark, path) if upto is None else upto
    if number < 0 or number in before:
        return
    read_newest(spark, path, schema, keys, version, number).write.mode("overwrite").parquet(f"{path}/generation={number}")
    if before:
        for old in _numbers(spark, path, "batch"):
            if old <= before[-1]:
                remove(spark, f"{path}/batch={old}")
        for old in before[:-1]:
            remove(spark, f"{path}/generation={old}")
