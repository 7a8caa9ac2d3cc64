"""The live view: the last samples of each series and what they say."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from hoplens.functions.series import display_value, health_band, live_scale, window_index, zero_fill
from hoplens.schema import SERIES
from hoplens.settings import LIVE_WINDOW

# Positions of one series handled by one task at most.
CHUNK = 1_000_000


def rolling_max(samples: DataFrame, size: int = LIVE_WINDOW, chunk: int = CHUNK) -> DataFrame:
    """Maximum of the last ``size`` zero-filled samples at every sample; earlier than the first, they are zero.

    A series is cut into chunks of positions so that a long one spreads over many tasks; the last ``size - 1`` rows of a chunk are
    repeated before the next. Positions are also cut into blocks of ``size``. A window reaches over two blocks at most, so its
    maximum is the larger of two running maxima: from the start of its last block on, and back from the end of the block before.
    So the work for a row does not grow with ``size``.
    """
    chunk = max(chunk, size)
    rows = samples.select(*SERIES, "seq", zero_fill(F.col("latency_ms")).alias("live_ms"))
    own = window_index(F.col("seq"), chunk)
    # The chunk whose windows reach back to the row: the next one, near the end of a chunk. Rows stay where numbering has put them.
    reaching = window_index(F.col("seq") + (size - 1), chunk)
    spread = rows.withColumn("_chunk", F.explode(F.when(reaching > own, F.array(own, reaching)).otherwise(F.array(own))))
    keys = [*SERIES, "_chunk"]
    block = Window.partitionBy(*keys, "_block")
    from_start = F.max("live_ms").over(block.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    from_end = F.max("live_ms").over(block.orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0))
    back = F.lag("_from_end", size - 1).over(Window.partitionBy(*keys).orderBy("seq"))
    # At a series' beginning there is no row so far back; then all rows of its first block count.
    return (
        spread.withColumn("_block", window_index(F.col("seq"), size))
        .withColumn("_from_end", from_end)
        .withColumn("_from_start", from_start)
        .withColumn("_top", F.greatest("_from_start", back))
        .where(F.col("_chunk") == own)
        .select(*SERIES, "seq", "live_ms", _with_seed(F.col("_top"), size).alias("window_max"))
    )


def _with_seed(top: Column, size: int) -> Column:
    """Until ``size`` samples have come in, zeros of the initial buffer are still part of the window."""
    return F.when(F.col("seq") < size, F.greatest(top, F.lit(0.0))).otherwise(top)


def tail_n(samples: DataFrame, count: int = LIVE_WINDOW) -> DataFrame:
    """Last ``count`` samples of each series; tasks drop all but their own last ones before the shuffle."""
    newest = Window.partitionBy(*SERIES).orderBy(F.col("seq").desc())
    return samples.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= count).drop("_back")


def rolling_buffer(samples: DataFrame, size: int = LIVE_WINDOW) -> DataFrame:
    """The live buffer of each series at the end of the data, padded with zeros on the left."""
    pairs = F.sort_array(F.collect_list(F.struct("seq", zero_fill(F.col("latency_ms")).alias("live_ms"))))
    return (
        tail_n(samples, size)
        .groupBy(*SERIES)
        .agg(pairs.alias("pairs"))
        .select(
            *SERIES,
            F.concat(
                F.array_repeat(F.lit(0.0), size - F.size("pairs")), F.transform("pairs", lambda pair: pair["live_ms"])
            ).alias("buffer"),
        )
    )


def live_status(samples: DataFrame, size: int = LIVE_WINDOW) -> DataFrame:
    """Latest value, window maximum, scale and health band of each series at the end of the data."""
    live = zero_fill(F.col("latency_ms"))
    latest = (
        tail_n(samples, size)
        .groupBy(*SERIES)
        .agg(
            F.max("seq").alias("seq"),
            F.max_by("latency_ms", "seq").alias("latest_ms"),
            F.max(live).alias("top"),
        )
        .withColumn("window_max", _with_seed(F.col("top"), size))
    )
    return describe_live(latest)


def describe_live(latest: DataFrame) -> DataFrame:
    """Texts and scale of a live window, from its latest latency and its maximum."""
    return latest.select(
        *SERIES,
        "seq",
        display_value(F.col("latest_ms")).alias("latest"),
        "window_max",
        live_scale(F.col("window_max")).alias("scale_max"),
        health_band(F.col("window_max")).alias("band"),
    )
