"""Column names and schemas shared by every module.

A *sample* is one probe of one target: its latency in milliseconds, or NULL when the probe was lost.
``seq`` is the 1-based, dense position of the sample inside its ``(run_id, target)`` series; it is what
the operators call time. ``run_id`` and ``target`` may be NULL or empty: a NULL is a key like any other, in joins too. As a
folder name both become the same, so readers of stored text and samples give an empty one.
"""

from pyspark.sql import DataFrame, functions as F, types as T

SERIES = ["run_id", "target"]


def with_keys(rows: DataFrame, folders: list[str]) -> DataFrame:
    """Rows whose keys were folder names: an empty one is read as NULL and becomes empty again. Filters still prune."""
    return rows.withColumns({name: F.when(F.col(name).isNull(), "").otherwise(F.col(name)) for name in folders})


SAMPLES = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("malformed", T.BooleanType()),
    ]
)

# What a text result file holds: no wall clock, so no ``ts``.
TEXT_SAMPLES = T.StructType([f for f in SAMPLES.fields if f.name != "ts"])

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
