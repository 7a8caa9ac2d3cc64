"""Operators on streams of samples."""

import math
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hoplens.functions.series import measured
from hoplens.operators.live import describe_live
from hoplens.operators.summary import target_summary
from hoplens.schema import SERIES
from hoplens.settings import LIVE_WINDOW

# Stands for a missing time or tie breaker: before all others.
NO_CLOCK = -(2**62)


def time_windows(stream: DataFrame, length: str, delay: str) -> DataFrame:
    """Mean latency and loss per series and stretch of event time. Rows later than ``delay`` are dropped."""
    latency = F.col("latency_ms")
    lost = F.col("n") - F.col("arrived")
    return (
        stream.withWatermark("ts", delay)
        .groupBy(*SERIES, F.window("ts", length).alias("span"))
        .agg(F.count("*").alias("n"), F.count(latency).alias("arrived"), F.avg(latency).alias("mean"))
        .select(
            *SERIES,
            F.col("span.start").alias("window_start"),
            F.col("span.end").alias("window_end"),
            "n",
            lost.alias("lost"),
            F.coalesce(F.nanvl("mean", F.lit(0.0)), F.lit(0.0)).alias("mean_latency_ms"),
            (lost / F.col("n") * 100).alias("packet_loss_pct"),
        )
    )


def live_updates(stream: DataFrame, tie: str, size: int = LIVE_WINDOW, idle_ms: int | None = None) -> DataFrame:
    """Live status of each series after each batch that brought samples of it; ``seq`` counts them.

    State is the last ``size`` samples by (``ts``, ``tie``), so the outcome does not depend on how rows fell into batches.
    Before the shuffle each Arrow batch keeps only its own last ``size`` rows of a series with the count of all,
    so a series with very many rows reaches its one state holder thinned out. Samples without ``ts`` come before those with
    one, by ``tie``. After ``idle_ms`` without samples the state of a series is freed, its last status having been given;
    a later sample starts it anew. Such a query must be paced, as one that ends with the data there is waits for timeouts. By
    default state stays.
    """
    rows = stream.select(
        *SERIES,
        F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(NO_CLOCK)).alias("at"),
        F.coalesce(F.col(tie).cast("long"), F.lit(NO_CLOCK)).alias("tie"),
        "latency_ms",
    )
    order = ["at", "tie"]

    def keep_newest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values(order)
            in_series = batch.groupby(SERIES, sort=False, dropna=False)["at"].transform("size")
            last = ~batch.duplicated(SERIES, keep="last")
            batch["n_rows"] = in_series.where(last, 0)
            yield batch.groupby(SERIES, sort=False, dropna=False).tail(size)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # A series has few rows at a time, so lists cost less than frames.
        seen, *columns = state.get if state.exists else (0, [], [], [])
        buffer = list(zip(*columns))
        for batch in batches:
            seen += int(batch["n_rows"].sum())
            buffer += zip(*(batch[name].tolist() for name in (*order, "latency_ms")))
            buffer = sorted(buffer, key=itemgetter(0, 1))[-size:]
        at, ties, latencies = (list(column) for column in zip(*buffer))
        latencies = [math.nan if latency is None else latency for latency in latencies]
        state.update((seen, at, ties, latencies))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        top = max(0.0 if math.isnan(latency) else latency for latency in latencies)
        yield pd.DataFrame(
            {
                "run_id": [key[0]],
                "target": [key[1]],
                "seq": [seen],
                "latest_ms": [latencies[-1]],
                "window_max": [max(top, 0.0) if seen < size else top],
            }
        )

    statuses = (
        rows.mapInPandas(keep_newest, "run_id string, target string, at bigint, tie bigint, latency_ms double, n_rows bigint")
        .groupBy(*SERIES)
        .applyInPandasWithState(
            update,
            "run_id string, target string, seq bigint, latest_ms double, window_max double",
            "seen bigint, at array<bigint>, tie array<bigint>, latency_ms array<double>",
            "append",
            GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
        )
    )
    return describe_live(statuses)


def summary_updates(stream: DataFrame) -> DataFrame:
    """Running summary of each series, for sinks that take updates, such as ``streams.store_updates``.

    Spark's own aggregation: each batch is added up before the shuffle. State is one row per series and stays, as a series
    may go on at any time; where series end, ``closed_runs`` frees it.
    """
    return target_summary(stream)


def closed_runs(stream: DataFrame, gap: str, delay: str) -> DataFrame:
    """Summary of each stretch of a series without a pause longer than ``gap``, once, when it is over.

    A stretch is over when event time has passed its last sample by ``gap`` and ``delay``; then its row is given out and its
    state freed, so the state is that of the stretches still open. Samples later than that are dropped, and so are samples without
    ``ts``, which belong to no stretch. ``from_ts`` and ``to_ts`` are its first and last sample's time.

    The state of a stretch is one row of sums, however many samples it has. Each task adds its own samples up before the shuffle, if
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` is set.
    """
    latency = measured(F.col("latency_ms"))
    total, successful = F.col("total"), F.col("successful")
    return (
        stream.where(F.col("ts").isNotNull())
        .withWatermark("ts", delay)
        .groupBy(*SERIES, F.session_window("ts", gap).alias("span"))
        .agg(
            F.count("*").alias("total"),
            F.count(latency).alias("successful"),
            F.avg(latency).alias("avg_ms"),
            F.min(latency).alias("min_ms"),
            F.max(latency).alias("max_ms"),
        )
        .select(
            *SERIES,
            F.col("span.start").alias("from_ts"),
            (F.col("span.end") - F.expr(f"INTERVAL {gap}")).alias("to_ts"),
            "total",
            "successful",
            ((total - successful) / total * 100).alias("packet_loss_pct"),
            "avg_ms",
            "min_ms",
            "max_ms",
        )
    )
