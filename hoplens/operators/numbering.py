"""Dense positions inside each series."""

from math import ceil

from pyspark.sql import DataFrame, Window, functions as F

from hoplens.operators.extent import Extent, measure, series_lengths
from hoplens.operators.keys import join_keys
from hoplens.schema import SERIES
from hoplens.session import use_checkpoints

# One task numbers at most about this many rows, whatever the length of a series. They are sorted, so they may spill.
ROWS_PER_TASK = 1_000_000
MAX_BROADCAST_ROWS = 500_000


def with_seq(
    samples: DataFrame,
    order: list[str],
    extent: Extent | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``seq``, the 1-based position of a row in its series by ``order``.

    A series that fits one task is numbered by a plain window, with a single shuffle by series. Where the measured
    extent shows longer ones, a window would put each of them whole into one task, so their rows are split off and
    cut by range of the full sort key instead. Without a given extent, the rows of the whole table are
    counted first, which for files reads no column; no series is longer than that.
    """
    if extent is None and samples.count() > rows_per_task:
        extent = measure(samples)
    if extent is None or extent.longest <= rows_per_task:
        return _number_whole(samples, order)
    parts = ceil(extent.rows / rows_per_task)
    long_series = series_lengths(samples).where(F.col("n") > rows_per_task).select(*SERIES)
    # There are fewer long series than parts.
    if parts <= MAX_BROADCAST_ROWS:
        long_series = F.broadcast(long_series)
    short = join_keys(samples, long_series, SERIES, "left_anti")
    long = join_keys(samples, long_series, SERIES, "left_semi")
    return _number_whole(short, order).unionByName(_number_by_range(long, order, parts))


def _number_whole(samples: DataFrame, order: list[str]) -> DataFrame:
    series = Window.partitionBy(*SERIES).orderBy(*order)
    return samples.withColumn("seq", F.row_number().over(series).cast("long"))


def _number_by_range(samples: DataFrame, order: list[str], parts: int) -> DataFrame:
    """Sort rows into even ranges, then add to each local position what lies in earlier ranges.

    The tie breaker keeps even a great many copies of one row from landing in one range. The ranges are
    checkpointed because their bounds are sampled: both uses below must see the same cut, also after a loss of executors.
    Spark removes the checkpoint when the frame is no longer used, if ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    spark = samples.sparkSession
    parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = [*SERIES, *order, "_tie"]
    cut = (
        samples.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, *key)
        .sortWithinPartitions(*key)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
        .drop("_tie")
    )
    use_checkpoints(spark)
    ranges = cut.checkpoint()
    earlier = Window.partitionBy(*SERIES).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranges.groupBy(*SERIES, "_part")
        .agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    # Each part is contiguous and there are fewer long series than parts, so this has at most twice as many rows as parts.
    if 2 * parts <= MAX_BROADCAST_ROWS:
        starts = F.broadcast(starts)
    return (
        join_keys(ranges, starts, [*SERIES, "_part"])
        .withColumn("seq", F.col("_pos") - F.col("_first") + F.col("_before") + 1)
        .drop("_part", "_pos", "_first", "_before")
    )
