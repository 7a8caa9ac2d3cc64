"""The size of a samples table, measured once, so that plans are chosen by size and not by hope."""

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from hoplens.operators.keys import join_keys
from hoplens.schema import SERIES

# More runs than this stay distributed; up to here the per-run table (two columns) is at most a few MB.
MAX_RUNS_ON_DRIVER = 100_000
# Beyond that, so many of its rows are still sent to every task, some tens of bytes each.
MAX_BROADCAST_RUNS = 1_000_000


@dataclass(frozen=True)
class Extent:
    runs: int  # number of runs
    series: int  # number of (run, target) pairs
    rows: int  # number of samples
    longest: int  # samples in the longest series
    times: int  # sum over runs of the longest series: bounds the distinct (run, seq) pairs
    per_run: DataFrame = field(repr=False)  # run_id, max_seq
    known: tuple | None = field(default=None, repr=False)  # the rows of per_run, if there are few

    @cached_property
    def by_run(self) -> DataFrame:
        """Length of the longest series of each run; broadcast if its counted rows are few."""
        if self.known is None:
            return F.broadcast(self.per_run) if self.runs <= MAX_BROADCAST_RUNS else self.per_run
        return F.broadcast(self.per_run.sparkSession.createDataFrame(self.known, "run_id string, max_seq bigint"))

    def with_max_seq(self, rows: DataFrame) -> DataFrame:
        """Add the length of the longest series of the row's run, which may be NULL; a single run needs no join."""
        if self.runs == 1:
            return rows.withColumn("max_seq", F.lit(self.longest).cast("long"))
        return join_keys(rows, self.by_run, ["run_id"])


def series_lengths(samples: DataFrame) -> DataFrame:
    """Samples per series. Only the two key columns are read, and counts are combined before the shuffle."""
    return samples.groupBy(*SERIES).agg(F.count("*").alias("n"))


def max_duration(samples: DataFrame) -> DataFrame:
    """Length of the longest series of each run."""
    return series_lengths(samples).groupBy("run_id").agg(F.max("n").alias("max_seq"))


def measure(samples: DataFrame, max_runs: int = MAX_RUNS_ON_DRIVER) -> Extent:
    """Runs one narrow job, and a second one only if there are more than ``max_runs`` runs."""
    return extent_of(series_lengths(samples), max_runs)


def extent_of(lengths: DataFrame, max_runs: int = MAX_RUNS_ON_DRIVER) -> Extent:
    """The extent, from the length ``n`` of each series."""
    per_run = lengths.groupBy("run_id").agg(
        F.max("n").alias("max_seq"), F.count("*").alias("series"), F.sum("n").alias("rows")
    )
    maxima = per_run.select("run_id", "max_seq")
    found = per_run.limit(max_runs + 1).collect()
    if len(found) <= max_runs:
        return Extent(
            runs=len(found),
            series=sum(run.series for run in found),
            rows=sum(run["rows"] for run in found),
            longest=max((run.max_seq for run in found), default=0),
            times=sum(run.max_seq for run in found),
            per_run=maxima,
            known=tuple((run.run_id, run.max_seq) for run in found),
        )
    total = per_run.agg(
        F.count("*").alias("runs"),
        F.sum("series").alias("series"),
        F.sum("rows").alias("rows"),
        F.max("max_seq").alias("longest"),
        F.sum("max_seq").alias("times"),
    ).first()
    return Extent(**total.asDict(), per_run=maxima)
