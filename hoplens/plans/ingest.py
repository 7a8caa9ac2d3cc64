"""Text results to a samples table, each byte once.

The table's folder has a ledger, ``_ledger``: for every file its size, the time of its last change and the number of its lines. An ingest
compares it with what is there now. Files that have not changed are not opened, files that have grown are read from where they ended,
and runs of which a file was rewritten are read anew.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from hoplens.functions.parsing import labelled, parse_lines, run_from_path, target_from_path
from hoplens.operators.keys import join_keys
from hoplens.operators.numbering import with_seq
from hoplens.operators.partials import PARTIALS, merged, partials
from hoplens.schema import SAMPLES, SERIES, with_keys
from hoplens.sources import updates
from hoplens.sources.appended import ended, read_ranges
from hoplens.sources.folders import matching, remove
from hoplens.sources.sinks import write_samples
from hoplens.sources.tables import read_samples
from hoplens.sources.text import RESULT_FILES, scan_runs

LEDGER = "path string, folder string, run_id string, target string, bytes bigint, modified timestamp, lines bigint, ended boolean, gen bigint"
# Batches of the ledger after which it is merged.
MERGE_EVERY = 20
# Grown files, up to so many of which are sent to every task; beyond, their lines are joined with them by a shuffle.
MAX_BROADCAST_FILES = 100_000


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """What the table at ``path`` has of each result file."""
    return updates.read_newest(spark, f"{path}/_ledger", LEDGER, ["path"], "gen")


def list_files(spark: SparkSession, *folders: str, label: str | None = None) -> DataFrame:
    """Result files directly in run folders, by their listing alone: contents are not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", RESULT_FILES).load(list(folders))
    path = F.col("path")
    return listed.select(
        "path",
        F.regexp_extract(path, "^(.*)/", 1).alias("folder"),
        labelled(run_from_path(path), label).alias("run_id"),
        target_from_path(path).alias("target"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
    )


def ingest_runs(spark: SparkSession, path: str, *folders: str, label: str | None = None) -> DataFrame:
    """Put what is new in run folders into the table at ``path`` and return the whole table.

    Afterwards the table holds of these folders what ``scan_runs`` reads from them, whatever was ingested before: nothing changes
    where nothing changed. A run is named as there. Two folders under one name are refused, in one call or in two; ingest
    each root under a label of its own.

    The ledger's batch is the commit. What an ingest that was broken off has stored is removed by the next one. One ingest runs
    at a time. While a run with a rewritten file is read anew, the table lacks it.
    """
    log = f"{path}/_ledger"
    gen = updates.last_batch(spark, log) + 1
    for left in matching(spark, f"{path}/run_id=*/gen={gen}") + matching(spark, f"{path}/_partials/run_id=*/gen={gen}"):
        remove(spark, left)
    known = ledger(spark, path)
    now = list_files(spark, *folders, label=label)
    _refuse_shared_names(now, known)

    before = known.select("path", *(F.col(name).alias(f"old_{name}") for name in ("bytes", "modified", "lines", "ended")))
    files = now.join(before, "path", "left")
    rewritten = (F.col("bytes") < F.col("old_bytes")) | (
        (F.col("bytes") == F.col("old_bytes")) & (F.col("modified") != F.col("old_modified"))
    ) | ((F.col("bytes") > F.col("old_bytes")) & ~F.col("old_ended"))
    state = (
        F.when(F.col("old_bytes").isNull(), "new").when(rewritten, "rewritten").when(F.col("bytes") > F.col("old_bytes"), "grown").otherwise("same")
    )
    # Listings leave empty files out, so one that is gone from a listed folder is empty or removed.
    gone = known.where("bytes > 0").join(now.select("path"), "path", "left_anti").join(now.select("folder").distinct(), "folder", "left_semi")
    gone = gone.select("path", "folder", *SERIES, F.lit(0).cast("long").alias("bytes"), "modified", F.lit("rewritten").alias("state"))
    changed = files.withColumn("state", state).where("state <> 'same'").unionByName(gone, allowMissingColumns=True)
    if changed.isEmpty():
        return read_samples(spark, path) if gen else spark.createDataFrame([], SAMPLES)

    runs = changed.groupBy("run_id", "folder").agg(F.bool_or(F.col("state") == "rewritten").alias("rewritten"))
    stored = known.select("run_id").distinct().withColumn("stored", F.lit(True))
    runs = join_keys(runs, stored, ["run_id"], "left").withColumn("anew", F.col("rewritten") | F.col("stored").isNull())
    # Folders to be read as a whole: as many as there are new runs, and Spark lists them by name.
    anew = runs.where("anew").collect()
    for run in anew:
        for place in (path, f"{path}/_partials"):
            for old in matching(spark, f"{place}/run_id={_escaped(run.run_id)}"):
                remove(spark, old)
    if anew:
        whole = scan_runs(spark, *(_pattern(run.folder) for run in anew), label=label)
        write_samples(whole.drop("run_ts"), path, mode="replace", gen=gen)
    grown = join_keys(changed, runs.where("NOT anew").select("run_id"), ["run_id"])
    grown = grown.withColumn("start", F.coalesce("old_bytes", F.lit(0)))
    if not grown.isEmpty():
        write_samples(_continued(grown), path, mode="replace", gen=gen)

    _add_partials(spark, path, gen)
    there = now.unionByName(gone.select(*now.columns))
    taken = join_keys(there, runs.where("anew").select("run_id"), ["run_id"]).unionByName(grown.select(*now.columns))
    _commit(spark, path, log, gen, taken, list_files(spark, *folders, label=label))
    return read_samples(spark, path)


def _continued(grown: DataFrame) -> DataFrame:
    """Samples of the bytes that files got, numbered on from the lines before.

    Spark takes the lines for as few as the ranges that they are read from. So the join is told its way, or they would be its small
    side and be collected on the driver.
    """
    ranges = grown.select("path", "start", F.col("bytes").alias("stop"))
    whose = grown.select("path", *SERIES, F.coalesce("old_lines", F.lit(0)).alias("lines"))
    few = grown.limit(MAX_BROADCAST_FILES + 1).count() <= MAX_BROADCAST_FILES
    lines = parse_lines(read_ranges(ranges)).join(F.broadcast(whose) if few else whose.hint("merge"), "path")
    return with_seq(lines, ["at"]).withColumn("seq", F.col("seq") + F.col("lines")).select(*SERIES, "seq", "latency_ms", "malformed")


def _generation(spark: SparkSession, path: str, gen: int) -> DataFrame:
    """Samples that one ingest has stored."""
    schema = "target string, seq bigint, latency_ms double, malformed boolean, run_id string, gen bigint"
    return with_keys(spark.read.schema(schema).parquet(path).where(F.col("gen") == gen), ["run_id"])


def _add_partials(spark: SparkSession, path: str, gen: int) -> None:
    rows = partials(_generation(spark, path, gen)).withColumn("gen", F.lit(gen).cast("long"))
    writer = rows.hint("rebalance", "run_id").sortWithinPartitions(*SERIES, "block").write.partitionBy("run_id", "gen")
    writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{path}/_partials")


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    """Partials of the samples in the table at ``path``; what several ingests have of one block is added up."""
    rows = with_keys(spark.read.schema(f"{PARTIALS}, gen bigint").parquet(f"{path}/_partials"), ["run_id"])
    return merged(rows, [*SERIES, "block"])


def _commit(spark: SparkSession, path: str, log: str, gen: int, taken: DataFrame, after: DataFrame) -> None:
    """Add the files that were taken to the ledger, with the lines that the table has of them."""
    lines = _generation(spark, path, gen).groupBy(*SERIES).agg(F.max("seq").alias("lines"))
    # A file that has changed meanwhile is looked at again next time.
    later = after.select("path", F.col("bytes").alias("later"))
    rows = join_keys(taken, lines, SERIES, "left").join(ended(taken), "path").join(later, "path", "left")
    rows = rows.withColumn("ended", F.col("ended") & (F.col("bytes") == F.coalesce("later", F.lit(0)))).withColumn("lines", F.coalesce("lines", F.lit(0)))
    names = [name.split()[0] for name in LEDGER.split(", ")]
    updates.put(rows.withColumn("gen", F.lit(gen).cast("long")).select(*names), log, gen)
    if gen % MERGE_EVERY == MERGE_EVERY - 1:
        updates.merge(spark, log, LEDGER, ["path"], "gen")


def _refuse_shared_names(now: DataFrame, known: DataFrame) -> None:
    """One run, one folder."""
    sources = now.select("run_id", "folder").unionByName(known.select("run_id", "folder"))
    several = sources.groupBy("run_id").agg(F.min("folder").alias("one"), F.max("folder").alias("other")).where("one <> other").first()
    if several is not None:
        raise ValueError(f"run {several.run_id!r} is in {several.one} and {several.other}: ingest each root under a label of its own")


def _pattern(folder: str) -> str:
    """A path that Spark takes as a pattern, made to match itself alone."""
    return "".join(f"\\{sign}" if sign in "*?[]{}\\" else sign for sign in folder)


def _escaped(run_id: str) -> str:
    """A run's folder name as Spark writes it, as a pattern."""
    if not run_id:
        return "__HIVE_DEFAULT_PARTITION__"
    special = set("\"#%'*/:=?\\\x7f{[]^") | {chr(code) for code in range(1, 32)}
    return "".join(f"%{ord(sign):02X}" if sign in special else sign for sign in run_id)
