"""Stretches of consecutive positions with high latency."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from hoplens.operators.extent import MAX_RUNS_ON_DRIVER, Extent, measure
from hoplens.operators.keys import join_keys
from hoplens.operators.segments import segment_raw
from hoplens.schema import SERIES
from hoplens.settings import SEGMENT_SECONDS

# Positions numbered by one task at most, and rows of a table of distinct positions that may be broadcast.
BLOCK = 1_000_000
MAX_BROADCAST_TIMES = 500_000
SEGMENT = ["run_id", "segment_idx"]
SERIES_SEGMENT = [*SERIES, "segment_idx"]


def high_latency(
    samples: DataFrame,
    threshold: float = 200.0,
    segment_len: int | None = SEGMENT_SECONDS,
    extent: Extent | None = None,
) -> DataFrame:
    """Samples above ``threshold``. Lost samples count as 800 and so are high for any lower threshold."""
    return segment_raw(samples, segment_len, extent).where(F.col("ping_ms") > threshold)


def union_high_times(*sources: DataFrame) -> DataFrame:
    """High positions of several sources, one row per source row."""
    rows = [source.select(*SERIES_SEGMENT, "seq") for source in sources]
    union = rows[0]
    for more in rows[1:]:
        union = union.unionByName(more)
    return union


def distinct_times(high: DataFrame) -> DataFrame:
    """Each high position once per segment, whoever was high there."""
    return high.select(*SEGMENT, "seq").distinct()


def high_times_sorted(high: DataFrame) -> DataFrame:
    return distinct_times(high).orderBy(*SEGMENT, "seq")


def with_island(times: DataFrame, keys: list[str], segment_len: int | None, block: int = BLOCK) -> DataFrame:
    """Add ``island``, equal for positions of one unbroken stretch. Positions are unique within ``keys``.

    A stretch keeps ``seq`` minus its rank constant. A segment of at most ``block`` positions is ranked in one task.
    Longer ones are ranked block by block, and each block starts from the number of positions before it.
    """
    if segment_len is not None and segment_len <= block:
        ranked = Window.partitionBy(*keys).orderBy("seq")
        return times.withColumn("island", F.col("seq") - F.row_number().over(ranked))
    blocked = times.withColumn("_block", F.call_function("div", F.col("seq"), F.lit(block).cast("long")))
    in_block = Window.partitionBy(*keys, "_block").orderBy("seq")
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocked.groupBy(*keys, "_block")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        join_keys(blocked.withColumn("_rank", F.row_number().over(in_block)), starts, [*keys, "_block"])
        .withColumn("island", F.col("seq") - F.col("_rank") - F.col("_before"))
        .drop("_block", "_rank", "_before")
    )


def regions(
    high: DataFrame,
    segment_len: int | None = SEGMENT_SECONDS,
    by_target: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """First and last position of each stretch of high latency, across all targets or for each of them.

    Across targets the positions are first made distinct, with a combine before the shuffle, so the number of targets
    does not reach the ranking step.
    """
    keys = SERIES_SEGMENT if by_target else SEGMENT
    times = high.select(*keys, "seq") if by_target else distinct_times(high)
    return (
        with_island(times, keys, segment_len, block)
        .groupBy(*keys, "island")
        .agg(F.min("seq").alias("start_s"), F.max("seq").alias("end_s"))
        .drop("island")
    )


def pad_regions(
    found: DataFrame,
    segment_len: int | None = SEGMENT_SECONDS,
    extent: Extent | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Regions widened by half a position on both sides, with a mark on the first of each segment."""
    if segment_len is not None and segment_len <= block:
        first = F.row_number().over(Window.partitionBy(*SEGMENT).orderBy("start_s")) == 1
        marked = found.withColumn("is_first", first)
    else:
        firsts = found.groupBy(*SEGMENT).agg(F.min("start_s").alias("_first"))
        # Without segmentation this has one row per run.
        if segment_len is None and extent is not None and extent.runs <= MAX_RUNS_ON_DRIVER:
            firsts = F.broadcast(firsts)
        marked = join_keys(found, firsts, SEGMENT).withColumn("is_first", F.col("start_s") == F.col("_first")).drop("_first")
    return marked.withColumn("pad_start", F.col("start_s") - 0.5).withColumn("pad_end", F.col("end_s") + 0.5)


def samples_in_regions(
    samples: DataFrame,
    threshold: float = 200.0,
    segment_len: int | None = SEGMENT_SECONDS,
    extent: Extent | None = None,
    block: int = BLOCK,
    max_broadcast_times: int = MAX_BROADCAST_TIMES,
) -> DataFrame:
    """Every sample that lies in a region across targets, with the bounds of that region.

    Regions consist of whole positions and a sample sits on a whole position, so this is an equality join on the
    position. The distinct high positions are broadcast when the measured run lengths prove them few. Otherwise both
    sides are shuffled by position, and a position shared by very many targets is split by the adaptive skew join.
    """
    extent = extent or measure(samples)
    inside = segment_raw(samples, segment_len, extent)
    island = [*SEGMENT, "island"]
    times = with_island(distinct_times(inside.where(F.col("ping_ms") > threshold)), SEGMENT, segment_len, block)
    if segment_len is not None and segment_len <= block:
        whole = Window.partitionBy(*island)
        bounded = times.withColumn("start_s", F.min("seq").over(whole)).withColumn("end_s", F.max("seq").over(whole))
    else:
        spans = times.groupBy(*island).agg(F.min("seq").alias("start_s"), F.max("seq").alias("end_s"))
        bounded = join_keys(times, spans, island)
    bounded = bounded.drop("island")
    if extent.times <= max_broadcast_times:
        bounded = F.broadcast(bounded)
    return join_keys(inside, bounded, [*SEGMENT, "seq"]).select(*SERIES_SEGMENT, "seq", "ping_ms", "start_s", "end_s")


# Positions in a block of an interval join, and series that one of its groups of samples may have.
JOIN_BLOCK = 4096
JOIN_SERIES = 512
MOST_SALTS = 1024


def samples_in(
    samples: DataFrame,
    found: DataFrame,
    extent: Extent | None = None,
    block: int = JOIN_BLOCK,
) -> DataFrame:
    """Samples that lie in given regions, such as stored ones, with every column of the region that the sample lacks.

    ``found`` has ``run_id, start_s, end_s``, both bounds inside, and ``target`` if regions are of single targets. They may come from other
    samples, overlap, and have any length: a sample comes once for each region that it lies in. A run may be NULL.

    Positions are cut into blocks. A region stands in every block that it touches and a sample in its own, so blocks are joined by
    equality and the exact bounds are compared after that; no sample is compared with a region of another block. Where regions are of all
    targets, a block's samples are dealt out by target, in proportion to the measured number of series, and its regions repeated.
    """
    by_target = "target" in found.columns
    keys = SERIES if by_target else ["run_id"]
    salts = 1
    if not by_target:
        extent = extent or measure(samples)
        salts = min(MOST_SALTS, max(1, -(-extent.series // JOIN_SERIES)))
    size = F.lit(block).cast("long")

    def block_of(position: str) -> Column:
        return F.floor(F.col(position) / size).cast("long")

    rest = [name for name in found.columns if name in ("run_id", "target", "start_s", "end_s") or name not in samples.columns]
    touched = found.select(*rest).where("start_s <= end_s").withColumn("_block", F.explode(F.sequence(block_of("start_s"), block_of("end_s"))))
    placed = samples.withColumn("_block", block_of("seq"))
    if salts > 1:
        touched = join_keys(touched, placed.select(*keys, "_block").distinct(), [*keys, "_block"], "left_semi")
    touched = touched.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    placed = placed.withColumn("_salt", F.pmod(F.xxhash64("target"), F.lit(salts)).cast("int"))
    inside = (F.col("seq") >= F.col("start_s")) & (F.col("seq") <= F.col("end_s"))
    return join_keys(placed, touched.hint("merge"), [*keys, "_block", "_salt"]).where(inside).drop("_block", "_salt")
