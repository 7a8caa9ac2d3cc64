"""Fixed-size windows of consecutive samples."""

from pyspark.sql import DataFrame, functions as F

from hoplens.functions.series import measured, window_index
from hoplens.schema import SERIES
from hoplens.settings import LATENCY_CAP_MS, WINDOW_SAMPLES


def window_agg(samples: DataFrame, interval: int = WINDOW_SAMPLES, repair_nan: bool = True) -> DataFrame:
    """Mean latency and loss of every ``interval`` consecutive samples; the last window may be shorter.

    The mean is over the samples that arrived and 0.0 if none did. A NaN sample counts as arrived and makes the
    mean NaN; ``repair_nan`` turns such a mean into 0.0.
    """
    latency = F.col("latency_ms")
    windows = samples.groupBy(*SERIES, window_index(F.col("seq"), interval).alias("window_idx")).agg(
        F.count("*").alias("n"),
        F.count(latency).alias("arrived"),
        F.coalesce(F.avg(latency), F.lit(0.0)).alias("mean"),
        F.max(measured(latency)).alias("peak_ms"),
    )
    mean = F.nanvl(F.col("mean"), F.lit(0.0)) if repair_nan else F.col("mean")
    lost = F.col("n") - F.col("arrived")
    return windows.select(
        *SERIES,
        "window_idx",
        (F.col("window_idx") * interval + F.col("n") / 2).alias("mid_s"),
        "n",
        lost.alias("lost"),
        mean.alias("mean_latency_ms"),
        (lost / F.col("n") * 100).alias("packet_loss_pct"),
        "peak_ms",
    )


def gated_window_agg(
    samples: DataFrame, aggregate: bool, interval: int = WINDOW_SAMPLES, repair_nan: bool = True
) -> DataFrame:
    """Windows, or the same columns without rows when aggregation is off."""
    windows = window_agg(samples, interval, repair_nan)
    return windows if aggregate else windows.where(F.lit(False))


def all_lost_windows(windows: DataFrame) -> DataFrame:
    return windows.where(F.col("lost") == F.col("n"))


def window_head(samples: DataFrame, interval: int = WINDOW_SAMPLES, count: int = 5) -> DataFrame:
    """First windows of each series. Their numbers are dense, so this is a filter on the samples."""
    return window_agg(samples.where(F.col("seq") <= count * interval), interval)


def y_limit(
    samples: DataFrame, interval: int = WINDOW_SAMPLES, aggregate: bool = True, cap: float = LATENCY_CAP_MS
) -> DataFrame:
    """Upper axis end of each series: its peak plus 5 %, at most ``cap``; NULL if every sample was lost."""
    if aggregate:
        tops = window_agg(samples, interval, repair_nan=False).select(
            *SERIES, "peak_ms", measured(F.col("mean_latency_ms")).alias("top_mean")
        )
    else:
        tops = samples.select(
            *SERIES, measured(F.col("latency_ms")).alias("peak_ms"), F.lit(None).cast("double").alias("top_mean")
        )
    return axis_end(tops, cap)


def axis_end(tops: DataFrame, cap: float = LATENCY_CAP_MS) -> DataFrame:
    """``y_max`` of each series, from rows with a ``peak_ms`` and a ``top_mean``."""
    peak = tops.groupBy(*SERIES).agg(F.max("peak_ms").alias("peak"), F.max("top_mean").alias("top_mean"))
    top = F.greatest("peak", "top_mean")
    return peak.select(
        *SERIES,
        F.when(F.col("peak").isNull(), None)
        .when(top > cap, F.lit(cap))
        .otherwise(top * 1.05)
        .alias("y_max"),
    )
