"""Samples from tables."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hoplens.schema import EVENTS, SAMPLES, with_keys


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Canonical samples stored as Parquet. Positions are stored with them, so nothing is numbered again."""
    return with_keys(spark.read.schema(SAMPLES).parquet(path), ["run_id"]).select(*SAMPLES.names)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events by their declared schema, so that no job reads file footers to find one out."""
    return spark.read.schema(EVENTS).parquet(path)


def events_as_samples(events: DataFrame, target: Column, run_id: str = "events") -> DataFrame:
    """Events as probes: an ``error`` is a lost one, any other event's value is a latency.

    Not numbered yet: operators that ignore positions read them as they are, others take ``with_seq`` by
    ``EVENT_ORDER`` first.
    """
    return events.select(
        F.lit(run_id).alias("run_id"),
        F.coalesce(target.cast("string"), F.lit("")).alias("target"),
        "ts",
        "event_id",
        F.when(F.col("event_type") != "error", F.col("value")).alias("latency_ms"),
    )


EVENT_ORDER = ["ts", "event_id"]
