"""The whole analysis of finished runs, as lazy frames over one samples table."""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from hoplens.operators.extent import Extent, measure
from hoplens.operators.regions import high_latency, pad_regions, regions
from hoplens.operators.hosts import silent_in_runs
from hoplens.operators.partials import (
    empty_segments_of,
    malformed_of,
    measure_partials,
    summary_of,
    windows_of,
    y_limit_of,
)
from hoplens.operators.segments import empty_segment_ranges, segment_agg, segment_raw, segment_table, segment_titles
from hoplens.operators.summary import malformed_audit, summary_display, target_summary
from hoplens.operators.windows import all_lost_windows, gated_window_agg, y_limit
from hoplens.schema import SERIES
from hoplens.settings import Settings
from hoplens.sources.sinks import write_part
from hoplens.sources.text import scan_file, scan_runs


class Report(NamedTuple):
    segments: DataFrame
    raw_series: DataFrame
    agg_series: DataFrame
    regions: DataFrame
    y_limits: DataFrame
    summary: DataFrame
    summary_text: DataFrame
    lost_windows: DataFrame  # windows in which nothing arrived
    malformed: DataFrame  # lines that were neither a number nor lost, by series
    empty_segments: DataFrame  # segments without samples or windows, by series
    silent: DataFrame  # expected targets without samples, by run


def analyse(
    samples: DataFrame,
    settings: Settings = Settings(),
    extent: Extent | None = None,
    expected: DataFrame | None = None,
    repair_nan: bool = True,
    partials: DataFrame | None = None,
) -> Report:
    """Series, regions, summaries and gaps of numbered samples of any number of runs and targets.

    Measures the samples by a job where no ``extent`` is given; all else is lazy. ``expected`` has the targets that every run
    should have.

    With ``partials`` of the same samples, by default blocks, all parts but series and regions follow from them, and the samples are not read
    for them. ``ingest_runs`` keeps partials beside a table.
    """
    if partials is not None:
        return _from_partials(samples, partials, settings, extent, expected, repair_nan)
    extent = extent or measure(samples)
    length = settings.segment_len
    windows = gated_window_agg(samples, settings.aggregate, repair_nan=repair_nan)
    if "malformed" not in samples.columns:
        counted = samples.withColumn("malformed", F.lit(False))
    else:
        counted = samples
    nothing = samples.select(*SERIES).where(F.lit(False))
    high = high_latency(samples, settings.latency_threshold, length, extent)
    summary = target_summary(samples)
    return Report(
        segments=segment_titles(segment_table(extent, length)),
        raw_series=segment_raw(samples, length, extent),
        agg_series=segment_agg(windows, extent, length),
        regions=pad_regions(regions(high, length), length, extent),
        y_limits=y_limit(samples, aggregate=settings.aggregate),
        summary=summary,
        summary_text=summary_display(summary),
        lost_windows=all_lost_windows(windows),
        malformed=malformed_audit(counted),
        empty_segments=empty_segment_ranges(samples, length, aggregate=settings.aggregate, extent=extent),
        silent=nothing if expected is None else silent_in_runs(expected, samples),
    )


def _from_partials(
    samples: DataFrame, rows: DataFrame, settings: Settings, extent: Extent | None, expected: DataFrame | None, repair_nan: bool
) -> Report:
    extent = extent or measure_partials(rows)
    length, aggregate = settings.segment_len, settings.aggregate
    windows = windows_of(rows, repair_nan=repair_nan)
    windows = windows if aggregate else windows.where(F.lit(False))
    high = high_latency(samples, settings.latency_threshold, length, extent)
    summary = summary_of(rows)
    nothing = rows.select(*SERIES).where(F.lit(False))
    return Report(
        segments=segment_titles(segment_table(extent, length)),
        raw_series=segment_raw(samples, length, extent),
        agg_series=segment_agg(windows, extent, length),
        regions=pad_regions(regions(high, length), length, extent),
        y_limits=y_limit_of(rows, aggregate=aggregate),
        summary=summary,
        summary_text=summary_display(summary),
        lost_windows=all_lost_windows(windows),
        malformed=malformed_of(rows),
        empty_segments=empty_segments_of(rows, extent, length, aggregate=aggregate),
        silent=nothing if expected is None else silent_in_runs(expected, rows),
    )


def analyse_runs(spark: SparkSession, *folders: str, settings: Settings = Settings()) -> Report:
    """Analysis of run folders as they are. To analyse large ones more than once, ``ingest_runs`` them first."""
    return analyse(scan_runs(spark, *folders), settings)


def analyse_file(spark: SparkSession, path: str, settings: Settings = Settings()) -> Report:
    """Analysis of a single result file, NaN means kept; every part is empty if it does not exist."""
    return analyse(scan_file(spark, path), settings, repair_nan=False)


def write_report(report: Report, path: str) -> None:
    """Store every part of a report in its own folder under ``path``, beside what is there."""
    for name, part in report._asdict().items():
        write_part(part, f"{path}/{name}")
