"""Per-series statistics over whole runs."""

from pyspark.sql import DataFrame, functions as F

from hoplens.functions.series import fixed2, measured
from hoplens.schema import SERIES


def target_summary(samples: DataFrame) -> DataFrame:
    """Counts, loss and latency range of each series. Needs no positions and combines before the shuffle."""
    latency = measured(F.col("latency_ms"))
    return (
        samples.groupBy(*SERIES)
        .agg(
            F.count("*").alias("total"),
            F.count(latency).alias("successful"),
            F.avg(latency).alias("avg_ms"),
            F.min(latency).alias("min_ms"),
            F.max(latency).alias("max_ms"),
        )
        .withColumn("packet_loss_pct", (F.col("total") - F.col("successful")) / F.col("total") * 100)
        .select(*SERIES, "total", "successful", "packet_loss_pct", "avg_ms", "min_ms", "max_ms")
    )


def summary_display(summary: DataFrame) -> DataFrame:
    """The summary as the texts a report shows."""
    return summary.select(
        *SERIES,
        F.col("total").cast("string").alias("total_pings"),
        F.col("successful").cast("string").alias("successful_pings"),
        F.concat(fixed2(F.col("packet_loss_pct")), F.lit("%")).alias("packet_loss"),
        fixed2(F.col("avg_ms")).alias("average_latency"),
        fixed2(F.col("min_ms")).alias("min_latency"),
        fixed2(F.col("max_ms")).alias("max_latency"),
    )


def distinct_targets(samples: DataFrame) -> DataFrame:
    return samples.select(*SERIES).distinct()


def malformed_audit(samples: DataFrame) -> DataFrame:
    """How many lines of each series were neither a number nor ``Lost``."""
    return samples.groupBy(*SERIES).agg(
        F.count("*").alias("n_lines"), F.count_if("malformed").alias("n_malformed")
    )
