"""Lists of hosts: valid, invalid and silent ones."""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hoplens.functions.hosts import is_host, is_ipv4
from hoplens.operators.keys import join_keys
from hoplens.schema import SERIES
from hoplens.session import scratch_path
from hoplens.settings import DEFAULT_HOSTS


def host_list(spark: SparkSession, hosts: Iterable[str] | None = None) -> DataFrame:
    """Hosts as given, repeats included, or the default host where none are given."""
    given = list(hosts or DEFAULT_HOSTS)
    return spark.createDataFrame(list(enumerate(given)), "position bigint, target string")


def check_hosts(hosts: DataFrame) -> DataFrame:
    """Mark every row of a host table as valid or not."""
    target = F.col("target")
    return hosts.withColumn("is_valid", is_host(target)).withColumn(
        "version", F.when(is_ipv4(target), 4).when(is_host(target), 6)
    )


def valid_targets(hosts: DataFrame) -> DataFrame:
    return hosts.where(is_host(F.col("target")))


def invalid_targets(hosts: DataFrame) -> DataFrame:
    return hosts.where(~is_host(F.col("target")))


def require_valid_targets(hosts: DataFrame) -> DataFrame:
    """Valid hosts, or an error when there are none."""
    valid = valid_targets(hosts)
    if valid.isEmpty():
        raise ValueError("no valid IP addresses given")
    return valid


def silent_targets(expected: DataFrame, samples: DataFrame) -> DataFrame:
    """Expected targets without any sample; in a run of their own, if ``expected`` has a ``run_id``."""
    keys = [name for name in SERIES if name in expected.columns]
    return join_keys(expected, samples.select(*keys).distinct(), keys, "left_anti")


#: Targets in one bitmap, as Spark's functions of bitmaps have it.
BITMAP = 32_768


def silent_in_runs(expected: DataFrame, samples: DataFrame) -> DataFrame:
    """Expected targets (``target``) without any sample, for each run that has samples; a run may be NULL.

    Expected targets are numbered, and those that were heard in a run become bitmaps, one for ``BITMAP`` numbers. What a bitmap lacks is
    silent. So runs and targets are not paired before it is known which pairs are missing, a run's targets may be any
    number, and nothing passes the driver but their count.
    """
    wanted = expected.select("target").distinct()
    numbered = _numbered(wanted)
    count = numbered.count()
    heard = samples.select(*SERIES).distinct()
    known = join_keys(heard, numbered, ["target"])
    # Spark's functions count buckets and numbers from 1.
    from_one = F.col("number") + 1
    maps = known.groupBy("run_id", (F.bitmap_bucket_number(from_one) - 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(from_one)).alias("bits")
    )
    if not count:
        return heard.where(F.lit(False))
    buckets = -(-count // BITMAP)
    runs = heard.select("run_id").distinct()
    asked = runs.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    state = join_keys(asked, maps, ["run_id", "bucket"], "left")
    # Without any bit set there is no bitmap. ISO 8859-1 gives each byte the character of its number.
    letters = F.decode(F.coalesce("bits", F.unhex(F.repeat(F.lit("00"), BITMAP // 8))), "ISO-8859-1")
    last = F.least(F.lit(BITMAP), F.lit(count) - F.col("bucket") * BITMAP).cast("int") - 1
    bytewise = F.expr(
        "transform(sequence(0, last div 8), byte -> struct(byte, ascii(substr(letters, byte + 1, 1)) AS word))"
    )
    bits = (
        state.select("run_id", "bucket", letters.alias("letters"), last.alias("last"))
        .select("run_id", "bucket", "last", F.explode(bytewise).alias("at"))
        .where("at.word <> 255")
        .withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(7))))
        .where("shiftright(at.word, bit) & 1 = 0 AND at.byte * 8 + bit <= last")
        .select("run_id", (F.col("bucket") * BITMAP + F.col("at.byte") * 8 + F.col("bit")).alias("number"))
    )
    return bits.join(numbered, "number").select("run_id", "target")


def _numbered(targets: DataFrame) -> DataFrame:
    """Distinct targets with numbers from 0 without gaps: by the range that they fall in, and what lies in earlier ranges.

    They are stored, as their numbers are used twice and ranges are cut by a sample.
    """
    spark = targets.sparkSession
    path = scratch_path(spark, "targets")
    dealt = targets.repartitionByRange("target").sortWithinPartitions("target")
    dealt.select("target", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")).write.parquet(path)
    placed = spark.read.schema("target string, part int, place bigint").parquet(path)
    # One row for each range.
    ranges = placed.groupBy("part").agg(F.min("place").alias("first"), F.count("*").alias("own"))
    before = F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("part", "first", before.alias("before"))
    return placed.join(starts, "part").select("target", (F.col("place") - F.col("first") + F.col("before")).alias("number"))
