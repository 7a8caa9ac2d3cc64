"""Sums of samples by series and block of positions, that can be added up.

From them follow the size of a table, windows, summaries, axis limits, gaps and the audit of lines, so a report reads its samples
once to make them and not again for each part. Partials of different samples of one block are added, so samples that come later add
rows, and none of the earlier ones is read again.
"""

from pyspark.sql import Column, DataFrame, functions as F

from hoplens.functions.series import measured, window_index
from hoplens.operators.extent import MAX_RUNS_ON_DRIVER, Extent, extent_of
from hoplens.operators.segments import empty_ranges_of
from hoplens.operators.windows import axis_end
from hoplens.schema import SERIES
from hoplens.settings import LATENCY_CAP_MS, SEGMENT_SECONDS, WINDOW_SAMPLES

#: ``arrived`` counts latencies with NaN among them, ``measured`` without; sums and bounds are of measured ones.
PARTIALS = (
    "run_id string, target string, block bigint, n bigint, arrived bigint, measured bigint, n_malformed bigint, "
    "total_ms double, min_ms double, max_ms double"
)
ADDED = ["n", "arrived", "measured", "n_malformed", "total_ms"]


def partials(samples: DataFrame, block: int = WINDOW_SAMPLES) -> DataFrame:
    """One row for each block of positions of a series. One pass, combined before the shuffle."""
    latency = F.col("latency_ms")
    value = measured(latency)
    malformed = F.count_if("malformed") if "malformed" in samples.columns else F.sum(F.lit(0))
    return samples.groupBy(*SERIES, window_index(F.col("seq"), block).alias("block")).agg(
        F.count("*").alias("n"),
        F.count(latency).alias("arrived"),
        F.count(value).alias("measured"),
        malformed.cast("long").alias("n_malformed"),
        F.sum(value).alias("total_ms"),
        F.min(value).alias("min_ms"),
        F.max(value).alias("max_ms"),
    )


def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Partials added up over everything but ``keys``."""
    return rows.groupBy(*keys).agg(
        *(F.sum(name).alias(name) for name in ADDED), F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms")
    )


def _mean(repair_nan: bool) -> Column:
    """Mean of what arrived; 0.0 if nothing did. A NaN among it makes the mean NaN, or 0.0 where that is repaired."""
    broken = 0.0 if repair_nan else float("nan")
    mean = F.col("total_ms") / F.col("arrived")
    mean = F.nanvl(mean, F.lit(broken)) if repair_nan else mean
    return F.when(F.col("arrived") == 0, 0.0).when(F.col("measured") < F.col("arrived"), F.lit(broken)).otherwise(mean)


def windows_of(rows: DataFrame, interval: int = WINDOW_SAMPLES, block: int = WINDOW_SAMPLES, repair_nan: bool = True) -> DataFrame:
    """The windows of ``window_agg``, from partials of blocks that ``interval`` is a multiple of."""
    if interval % block:
        raise ValueError(f"windows of {interval} cannot be added up from blocks of {block}")
    index = F.call_function("div", F.col("block"), F.lit(interval // block).cast("long"))
    whole = merged(rows.withColumn("window_idx", index), [*SERIES, "window_idx"])
    lost = F.col("n") - F.col("arrived")
    return whole.select(
        *SERIES,
        "window_idx",
        (F.col("window_idx") * interval + F.col("n") / 2).alias("mid_s"),
        "n",
        lost.alias("lost"),
        _mean(repair_nan).alias("mean_latency_ms"),
        (lost / F.col("n") * 100).alias("packet_loss_pct"),
        F.col("max_ms").alias("peak_ms"),
    )


def summary_of(rows: DataFrame) -> DataFrame:
    """The rows of ``target_summary``."""
    total, successful = F.col("n"), F.col("measured")
    return merged(rows, SERIES).select(
        *SERIES,
        total.alias("total"),
        successful.alias("successful"),
        ((total - successful) / total * 100).alias("packet_loss_pct"),
        F.when(successful > 0, F.col("total_ms") / successful).alias("avg_ms"),
        "min_ms",
        "max_ms",
    )


def malformed_of(rows: DataFrame) -> DataFrame:
    """The rows of ``malformed_audit``."""
    return rows.groupBy(*SERIES).agg(F.sum("n").alias("n_lines"), F.sum("n_malformed").alias("n_malformed"))


def lengths_of(rows: DataFrame) -> DataFrame:
    """Samples of each series."""
    return rows.groupBy(*SERIES).agg(F.sum("n").alias("n"))


def measure_partials(rows: DataFrame, max_runs: int = MAX_RUNS_ON_DRIVER) -> Extent:
    """The extent of the samples, from their partials."""
    return extent_of(lengths_of(rows), max_runs)


def y_limit_of(
    rows: DataFrame, interval: int = WINDOW_SAMPLES, block: int = WINDOW_SAMPLES, aggregate: bool = True, cap: float = LATENCY_CAP_MS
) -> DataFrame:
    """The rows of ``y_limit``."""
    if aggregate:
        tops = windows_of(rows, interval, block, repair_nan=False).select(*SERIES, "peak_ms", measured(F.col("mean_latency_ms")).alias("top_mean"))
    else:
        tops = rows.select(*SERIES, F.col("max_ms").alias("peak_ms"), F.lit(None).cast("double").alias("top_mean"))
    return axis_end(tops, cap)


def empty_segments_of(
    rows: DataFrame,
    extent: Extent,
    segment_len: int | None = SEGMENT_SECONDS,
    interval: int = WINDOW_SAMPLES,
    aggregate: bool = True,
) -> DataFrame:
    """The rows of ``empty_segment_ranges``."""
    return empty_ranges_of(lengths_of(rows), extent, segment_len, interval, aggregate)
