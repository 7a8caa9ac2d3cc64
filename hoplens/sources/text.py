"""Samples from text result files: one line per sample, in the order of the probes.

Two layouts are read. In the *named* one, a file ``ping_results_<target>.txt`` holds one series and its folder,
``results_<clock>``, one run. In the *partitioned* one, as written by ``hoplens.sources.sinks``, folders ``run_id=…/target=…/block=…``
hold any number of part files. The second allows targets with characters that file names do not, such as IPv6 addresses.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hoplens.functions.parsing import decoded_path, labelled, parse_lines, run_clock, run_from_path, target_from_path
from hoplens.schema import SERIES, TEXT_SAMPLES, with_keys
from hoplens.sources.sinks import WRITE, write_log

RESULT_FILES = "ping_results_*.txt"


def scan_runs(spark: SparkSession, *folders: str, label: str | None = None) -> DataFrame:
    """Samples of all result files directly in the given run folders; patterns such as ``…/results_*`` work.

    ``run_ts`` is the run's clock, without a zone. A run is named by its folder's clock, behind ``label/`` if a label is given. That is so for every call, so a run keeps its name
    whatever else is read with it. Folders of several roots that would give one name to two runs are refused: scan each root
    under a label of its own, and unite.
    """
    lines = spark.read.option("pathGlobFilter", RESULT_FILES).text(list(folders))
    roots = {folder.rstrip("/").rpartition("/")[0] for folder in folders}
    if len(roots) > 1 or any(sign in root for root in roots for sign in "*?[{"):
        seen: dict[str, str] = {}
        for folder in sorted({file.rpartition("/")[0] for file in lines.inputFiles()}):
            name = folder.rpartition("/")[2]
            if seen.setdefault(name, folder) != folder:
                raise ValueError(f"{seen[name]} and {folder} would be one run: scan each root under a label of its own")
    return _named_samples(lines, one_file_per_series=True, label=label)


def scan_file(spark: SparkSession, path: str) -> DataFrame:
    """Samples of one result file, or of a folder of part files with one series; none if the path does not exist."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TEXT_SAMPLES)
    return _named_samples(lines, one_file_per_series=False)


def scan_partitioned(spark: SparkSession, root: str, where: str | Column | None = None) -> DataFrame:
    """Samples of a partitioned text folder. ``where``, on ``run_id`` and ``target``, prunes whole folders."""
    log = write_log(spark, root)
    if where is None:
        numbered = _number_parts(all_files(spark.read, root).select("value", *_place()), log)
        return with_keys(numbered.withColumns(folder_keys(F.col("_file"))), SERIES).select(*TEXT_SAMPLES.names)
    lines = with_keys(spark.read.schema("value string, run_id string, target string").text(root), SERIES).where(where)
    return _number_parts(lines.select(*SERIES, "value", *_place()), log).select(*TEXT_SAMPLES.names)


def all_files(reader, root: str) -> DataFrame:
    """Lines of all files below a partitioned text folder, by a reader of tables or of streams.

    Keys are to be taken from the paths by ``folder_keys``: to find them out as columns, Spark compares all folders on the driver, in a time
    that grows with the square of their number, and there is a folder for each target.
    """
    return reader.schema("value string").option("recursiveFileLookup", "true").text(root)


def folder_keys(file: Column) -> dict[str, Column]:
    """The keys of a file's series, from the folders that its URI names; NULL where the folder's name stands for no value."""
    path = decoded_path(file)
    names = {name: F.regexp_extract(path, f"/{name}=([^/]*)/", 1) for name in SERIES}
    return {name: F.when(key != "__HIVE_DEFAULT_PARTITION__", decoded_path(key)) for name, key in names.items()}


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """``run_id, target, value`` of every line of a partitioned text folder, in no order; an empty key is NULL."""
    return all_files(spark.read, root).select(*(key.alias(name) for name, key in folder_keys(F.col("_metadata.file_path")).items()), "value")


def _named_samples(lines: DataFrame, one_file_per_series: bool, label: str | None = None) -> DataFrame:
    """Samples whose run and target are in the path. They are taken from it last, so the shuffle carries one text.

    Where a series is one file, files too small to be split are read apart: nothing needs counting there.
    """
    if one_file_per_series:
        size, limit = F.col("_metadata.file_size"), _smallest_split(lines.sparkSession)
        whole = _ranked(lines.where(size <= limit).select("value", *_place()))
        cut = lines.where(size > limit).select("value", *_place())
        columns = ["_file", "seq", "latency_ms", "malformed"]
        numbered = whole.withColumnRenamed("_rank", "seq").select(*columns).unionByName(
            _number(cut, F.col("_file"), []).select(*columns)
        )
    else:
        numbered = _number_parts(lines.select("value", *_place()))
    path = decoded_path(F.col("_file"))
    named = numbered.select(
        labelled(run_from_path(path), label).alias("run_id"), target_from_path(path).alias("target"), "seq", "latency_ms", "malformed"
    )
    return named.withColumn("run_ts", run_clock(F.col("run_id"))) if one_file_per_series else named


def _place() -> list[Column]:
    """Where a line comes from: its file, the split of the file, and its order within the task that reads the split."""
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_line"),
    ]


SPLIT = ["_file", "_split"]


def _ranked(lines: DataFrame) -> DataFrame:
    """Rank the lines of each split, parsed before the shuffle. The reader bounds the size of a split."""
    rank = F.row_number().over(Window.partitionBy(*SPLIT).orderBy("_line"))
    return parse_lines(lines).withColumn("_rank", rank.cast("long"))


def _number_parts(lines: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Number the lines of series that are folders of part files.

    Files are in the order of the writes in the ``log``, those of no known write first; within a write in the order of their blocks
    of positions, or of the numbers that the write gave them.
    """
    file_order = [
        F.regexp_extract("_file", pattern, 1).try_cast("long")
        for pattern in (r"/block=([0-9]+)/[^/]*\z", r"/part-([0-9]+)[^/]*\z", r"/part-[^/]*-c([0-9]+)[^/]*\z")
    ]
    return _number(lines, F.regexp_extract("_file", "^(.*?)(?:/block=[0-9]+)?/[^/]*\\z", 1), file_order, log)


def _number(lines: DataFrame, series: Column, file_order: list[Column], log: DataFrame | None = None) -> DataFrame:
    """Number the lines of each series over all its splits.

    Ids of lines are consecutive within a split, so a line's rank is its distance from the first one of its split, to which the lines
    of earlier splits are added. Nothing is sorted, and lines are only joined with the few rows of their splits.

    Both uses of ``lines`` must cut files alike, and Spark sizes splits by the bytes it is to read. So no later filter may
    skip files for one use alone. Lines are therefore counted by their ids, which are consecutive within a split: a
    filter is not moved below a column of such ids as long as it is used.
    """
    counted = lines.groupBy(*SPLIT).agg(F.min("_line").alias("_first"), (F.max("_line") - F.min("_line") + 1).alias("_n"))
    if log is not None:
        writes = log.groupBy(F.col("write").alias("_write")).agg(F.min("number").alias("_number"))
        counted = counted.withColumn("_write", F.regexp_extract("_file", WRITE, 1)).join(writes, "_write", "left")
        file_order = ["_number", *file_order]
    earlier = Window.partitionBy(series).orderBy(*file_order, *SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(*SPLIT, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return (
        parse_lines(lines)
        .join(starts, SPLIT, "left")
        .withColumn("seq", F.col("_line") + F.col("_shift"))
        .drop("_shift", "_split", "_line")
    )


def _smallest_split(spark: SparkSession) -> int:
    """Files up to this size are never split, whatever the number of cores and files."""
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    return min(_bytes(spark, name) for name in sizes)


def _bytes(spark: SparkSession, name: str) -> int:
    text = spark.conf.get(name).strip().lower()
    number = text.rstrip("bkmgtp")
    unit = text[len(number):].rstrip("b")
    return int(number) * 1024 ** " kmgtp".index(unit or " ")
