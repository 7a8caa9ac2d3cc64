"""Segments of a run: equal stretches of the time axis that end with the run's longest series.

Segments are half open and the last one ends at the longest series' last position, so that one position belongs to
no segment, with and without segmentation.
"""

from pyspark.sql import Column, DataFrame, functions as F

from hoplens.functions.series import fill_and_clip, segment_index, span_text, window_index
from hoplens.operators.extent import Extent, measure, series_lengths
from hoplens.schema import SERIES
from hoplens.settings import SEGMENT_SECONDS, WINDOW_SAMPLES


def explode_range(rows: DataFrame, last: Column, name: str, step: int = 10_000) -> DataFrame:
    """One row per whole number from 0 to ``last``, in two steps so that no array grows with the range."""
    low = F.col("_low")
    return (
        rows.withColumn("_last", last)
        .withColumn("_low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"), F.lit(step).cast("long"))))
        .withColumn(name, F.explode(F.sequence(low, F.least(low + (step - 1), F.col("_last")))))
        .drop("_last", "_low")
    )


def segment_table(extent: Extent, segment_len: int | None = SEGMENT_SECONDS) -> DataFrame:
    """Start, end and label of every segment of every run."""
    index = F.col("segment_idx")
    length = F.col("max_seq") if segment_len is None else F.lit(segment_len).cast("long")
    label = F.lit("entire_duration") if segment_len is None else F.format_string("hour_%d", index + 1)
    last = segment_index(F.col("max_seq") - 1, segment_len)
    return explode_range(extent.by_run.where("max_seq >= 1"), last, "segment_idx").select(
        "run_id",
        "segment_idx",
        (index * length).alias("start_s"),
        F.least((index + 1) * length, F.col("max_seq")).alias("end_s"),
        label.alias("segment_label"),
    )


def segment_titles(segments: DataFrame) -> DataFrame:
    """Add the caption of a segment: its label in words and, when it is one of several, its span."""
    words = F.initcap(F.replace("segment_label", F.lit("_"), F.lit(" ")))
    span = F.concat(F.lit(" ("), span_text(F.col("start_s")), F.lit(" to "), span_text(F.col("end_s")), F.lit(")"))
    return segments.withColumn(
        "title", F.when(F.col("segment_label") == "entire_duration", words).otherwise(F.concat(words, span))
    )


def segment_raw(
    samples: DataFrame, segment_len: int | None = SEGMENT_SECONDS, extent: Extent | None = None
) -> DataFrame:
    """Samples with the segment they lie in and their filled and clipped series value ``ping_ms``.

    One pass over the samples, whatever the number of segments: the segment is a computed column.
    """
    extent = extent or measure(samples)
    return (
        extent.with_max_seq(samples)
        .where(F.col("seq") < F.col("max_seq"))
        .select(
            *SERIES,
            segment_index(F.col("seq"), segment_len).alias("segment_idx"),
            "seq",
            fill_and_clip(F.col("latency_ms")).alias("ping_ms"),
        )
    )


def segment_agg(
    windows: DataFrame, extent: Extent, segment_len: int | None = SEGMENT_SECONDS
) -> DataFrame:
    """Windows with the segment their midpoint lies in, for series that have samples in that segment.

    Positions are dense, so a position next to the midpoint always lies in the same segment, but for one case: a
    series of a single sample whose segment ends at position 1. The filter drops just that, without a join.
    """
    end = F.col("max_seq") if segment_len is None else F.least(F.lit(segment_len), F.col("max_seq"))
    no_samples = (F.col("window_idx") == 0) & (F.col("n") == 1) & (end <= 1)
    return (
        extent.with_max_seq(windows)
        .where(~no_samples)
        .select(
            *SERIES,
            segment_index(F.floor("mid_s"), segment_len).alias("segment_idx"),
            "window_idx",
            "mid_s",
            "mean_latency_ms",
            "packet_loss_pct",
        )
    )


def empty_segment_ranges(
    samples: DataFrame,
    segment_len: int | None = SEGMENT_SECONDS,
    interval: int = WINDOW_SAMPLES,
    aggregate: bool = True,
    extent: Extent | None = None,
) -> DataFrame:
    """Ranges of segments in which a series has no samples (``raw``) or samples but no window (``aggregated``).

    Positions are dense, so both follow from the length of a series: samples are counted, neither numbered nor joined. A series
    lacks samples in the segments after its own, one range however long the run. Only its own segments are looked at one by one.
    """
    return empty_ranges_of(series_lengths(samples), extent or measure(samples), segment_len, interval, aggregate)


def empty_ranges_of(
    lengths: DataFrame, extent: Extent, segment_len: int | None, interval: int, aggregate: bool
) -> DataFrame:
    """The ranges, from the length ``n`` of each series."""
    lengths = extent.with_max_seq(lengths).withColumn(
        "_last_segment", segment_index(F.col("max_seq") - 1, segment_len)
    )
    if segment_len is None:
        segment_len = 2**40  # one segment, longer than any series
    in_run = F.least("n", F.col("max_seq") - 1)
    # The first position is 1, so a segment of length 1 at position 0 has no sample.
    own_last = F.when(in_run >= 1, segment_index(in_run, segment_len)).otherwise(F.lit(-1).cast("long"))
    after = lengths.withColumn("from_segment", own_last + 1).where("from_segment <= _last_segment").select(
        *SERIES, "from_segment", F.col("_last_segment").alias("to_segment"), F.lit("raw").alias("series")
    )
    start, n = F.col("segment_idx") * segment_len, F.col("n")
    end = start + segment_len
    has_raw = F.least(in_run, end - 1) >= F.greatest(start, F.lit(1))
    # Midpoints are halves, so everything is doubled. The first full window at or after the start:
    first = F.greatest(F.lit(0), F.ceil((2 * start - interval) / (2 * interval)))
    full = (first < window_index(n + 1, interval)) & ((2 * first + 1) * interval < 2 * end)
    rest = n % interval
    tail_mid = 2 * n - rest
    tail = (rest > 0) & (tail_mid >= 2 * start) & (tail_mid < 2 * end)
    missing = F.when(~has_raw, "raw")
    if aggregate:
        missing = missing.when(~(full | tail), "aggregated")
    own = (
        explode_range(lengths.where(own_last >= 0), own_last, "segment_idx")
        .select(*SERIES, F.col("segment_idx").alias("from_segment"), F.col("segment_idx").alias("to_segment"), missing.alias("series"))
        .where("series IS NOT NULL")
    )
    return after.unionByName(own)


def empty_segments(
    samples: DataFrame,
    segment_len: int = SEGMENT_SECONDS,
    interval: int = WINDOW_SAMPLES,
    aggregate: bool = True,
    extent: Extent | None = None,
) -> DataFrame:
    """The ranges of ``empty_segment_ranges`` as one row per segment: as many as series times segments at worst."""
    ranges = empty_segment_ranges(samples, segment_len, interval, aggregate, extent)
    length = F.col("to_segment") - F.col("from_segment")
    return explode_range(ranges, length, "_step").select(
        *SERIES, (F.col("from_segment") + F.col("_step")).alias("segment_idx"), "series"
    )
