"""Column expressions that read latencies, targets and runs out of text."""

from pyspark.sql import Column, DataFrame, functions as F

# Text formats of result files, result folders and probe output.
NUMBER = (
    r"^[+-]?(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)"
    r"(?:[eE][+-]?[0-9](?:_?[0-9])*)?\z"
)
NAN = r"(?i)^[+-]?nan\z"
INFINITY = r"(?i)^\+?inf(inity)?\z"
MINUS_INFINITY = r"(?i)^-inf(inity)?\z"
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
RESULT_FILE = r"^ping_results_(.*)\.txt\z"
RESULT_FOLDER = r"^results_([0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9]{2}-[0-9]{2}-[0-9]{2})\z"
FOLDER = r"([^/]+)/[^/]+\z"
FILE = r"([^/]*)\z"
RUN_CLOCK = "yyyy-MM-dd_HH-mm-ss"
PROBE_LATENCY = {
    "unix": r"time\s*=\s*(\d+\.?\d*)\s*ms",
    "windows": r"time[=<]\s*(\d+\.?\d*)ms",
}


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, EDGE_SPACE, "")


def parse_latency(text: Column) -> Column:
    """Latency in a stripped result line, NULL when it is no number.

    The accepted numbers are those of Python's ``float``: underscores between digits, a bare point on either
    side, an exponent, ``nan`` and signed infinities. A cast alone would also accept ``1d`` or ``0x1p3``.
    """
    return (
        F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
        .when(text.rlike(NAN), F.lit(float("nan")))
        .when(text.rlike(INFINITY), F.lit(float("inf")))
        .when(text.rlike(MINUS_INFINITY), F.lit(float("-inf")))
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Replace the ``value`` of result lines by ``latency_ms`` and ``malformed``.

    A line that is neither a number nor ``Lost`` is malformed and counts as lost; a blank line is one of them. Steps
    are separate projections so that each text is stripped and parsed once.
    """
    return (
        lines.withColumn("value", stripped(F.col("value")))
        .withColumn("latency_ms", parse_latency(F.col("value")))
        .withColumn("malformed", F.col("latency_ms").isNull() & (F.lower("value") != "lost"))
        .drop("value")
    )


def probe_latency(output: Column, return_code: Column, platform: str = "unix") -> Column:
    """Latency in the text a probe printed; NULL for a failed probe or output without a time."""
    found = F.regexp_extract(output, PROBE_LATENCY[platform], 1)
    return F.when(return_code == 0, F.nullif(found, F.lit("")).try_cast("double"))


def target_from_name(name: Column) -> Column:
    """Target in a result file name, NULL for any other file."""
    return F.when(name.rlike(RESULT_FILE), F.regexp_extract(name, RESULT_FILE, 1))


def target_from_path(path: Column) -> Column:
    """Target of a result file, empty for any other file."""
    return F.regexp_extract(F.substring_index(path, "/", -1), RESULT_FILE, 1)


def run_from_path(path: Column) -> Column:
    """Run id of a result file: the clock in the name of its folder.

    A folder not named by the clock keeps its own name, so runs filed by hand stay apart.
    """
    # A pattern tries every place of a text, so it is given the end of the path alone.
    return F.regexp_replace(F.regexp_extract(F.substring_index(path, "/", -2), FOLDER, 1), RESULT_FOLDER, "$1")


def labelled(run_id: Column, label: str | None) -> Column:
    """The name of a run of a labelled root."""
    return run_id if label is None else F.concat(F.lit(f"{label}/"), run_id)


def decoded_path(uri: Column) -> Column:
    """The path behind the URI that file metadata gives."""
    return F.when(uri.contains("%"), F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))).otherwise(uri)


def run_clock(run_id: Column) -> Column:
    """Wall clock a run id was named after, behind a label or not, without a zone; NULL if the run is not named by the clock."""
    return F.try_to_timestamp(F.regexp_extract(run_id, FILE, 1), F.lit(RUN_CLOCK)).cast("timestamp_ntz")


def probe_clock(run_id: Column, seq: Column, ping_interval: int = 1) -> Column:
    """When a sample was taken: ``ping_interval`` seconds after the one before it, the first at its run's clock."""
    return F.timestamp_add("SECOND", (seq - 1) * ping_interval, run_clock(run_id))


def elapsed(seq: Column, ping_interval: int = 1) -> Column:
    """Seconds on the time axis: a position counts probes, and these are ``ping_interval`` seconds apart."""
    return seq * ping_interval
