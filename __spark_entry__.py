"""Registered queries and the SQL each of them is checked against.

Every query reads the given tables whole. ``events`` serves as probe samples in two ways: by user (many short series,
called A) and by user modulo three (few long ones, called B). An ``error`` event is a lost probe.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hoplens.functions.parsing import parse_lines, probe_latency, run_clock, run_from_path, target_from_name
from hoplens.functions.series import display_value, fill_and_clip, health_band, live_scale, segment_index, zero_fill
from hoplens.operators import hosts, live, regions, segments, summary, windows
from hoplens.operators.extent import Extent, max_duration, measure
from hoplens.operators.clock import with_clock
from hoplens.operators.keys import join_keys
from hoplens.operators.numbering import with_seq
from hoplens.plans.ingest import ingest_runs, ledger, read_partials
from hoplens.plans.report import analyse, write_report
from hoplens.schema import SAMPLES, SERIES
from hoplens.session import scratch_path
from hoplens.settings import Settings
from hoplens.sources import updates
from hoplens.sources.appended import appended_stream
from hoplens.sources.sinks import read_segments, write_part, write_samples, write_text
from hoplens.sources.tables import EVENT_ORDER, events_as_samples, read_events, read_samples
from hoplens.sources.text import read_lines, scan_file, scan_partitioned, scan_runs
from hoplens.streaming import operators as live_streams, streams

# Parameters of A, whose series are short. B uses the defaults: 60 samples, 3600 positions, 200 ms.
INTERVAL, SEGMENT, THRESHOLD = 10, 20, 100.0

Query = Callable[[SparkSession, str], DataFrame]


def entry(spark: SparkSession) -> DataFrame:
    """Minute means of latency and loss per target."""
    return window_agg_60(spark, "/root/testdata/sf0.001")


# Inputs


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_events(spark, f"{sf_dir}/events.parquet")


def _by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_samples(_events(spark, sf_dir), F.col("user_id"))


def _by_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_samples(_events(spark, sf_dir), F.col("user_id") % 3)


def _numbered(samples: DataFrame) -> tuple[DataFrame, Extent]:
    extent = measure(samples)
    return with_seq(samples, EVENT_ORDER, extent), extent


def _a(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Extent]:
    return _numbered(_by_user(spark, sf_dir))


def _b(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Extent]:
    return _numbered(_by_three(spark, sf_dir))


def _in_order(samples: DataFrame) -> DataFrame:
    return with_seq(samples, EVENT_ORDER)


def _twice(samples: DataFrame) -> DataFrame:
    """Latencies doubled, so that some lie above the 800 ms cap."""
    return samples.withColumn("latency_ms", F.col("latency_ms") * 2)


def _result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result lines of every kind a file may hold."""
    text = F.col("value").cast("string")
    kind = F.col("event_id") % 8
    line = (
        F.when(kind == 0, "Error: probe failed")
        .when(kind == 1, "")
        .when(kind == 2, "\tLOST ")
        .when(kind == 3, F.concat(text, F.lit("d")))
        .when(kind == 4, F.concat(F.lit(" +"), text))
        .when(kind == 5, F.concat(text, F.lit("e1")))
        .when(kind == 6, F.concat(F.lit("1_0"), text))
        .otherwise(text)
    )
    return _events(spark, sf_dir).select(
        F.lit("events").alias("run_id"), F.col("user_id").cast("string").alias("target"), "event_id", line.alias("value")
    )


def _round9(column: str) -> Column:
    return F.round(column, 9).alias(column)


def _windows(frame: DataFrame) -> DataFrame:
    return frame.select(
        "target", "window_idx", "mid_s", "n", "lost", _round9("mean_latency_ms"), _round9("packet_loss_pct")
    )


# Windows and summaries


def window_agg_60(spark, sf_dir):
    samples = _in_order(_by_three(spark, sf_dir))
    return _windows(windows.window_agg(samples))


def window_agg_10(spark, sf_dir):
    samples = _in_order(_by_user(spark, sf_dir))
    return _windows(windows.window_agg(samples, INTERVAL))


def window_agg_repair(spark, sf_dir):
    samples = _in_order(_by_user(spark, sf_dir))
    with_nan = samples.withColumn(
        "latency_ms", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("latency_ms"))
    )
    return _windows(windows.window_agg(with_nan, 5))


def all_lost_windows(spark, sf_dir):
    samples = _in_order(_by_user(spark, sf_dir))
    return _windows(windows.all_lost_windows(windows.window_agg(samples, 3)))


def window_head(spark, sf_dir):
    samples = _in_order(_by_user(spark, sf_dir))
    return _windows(windows.window_head(samples, INTERVAL))


def agg_gate(spark, sf_dir):
    samples = _in_order(_by_three(spark, sf_dir))
    gated = [
        windows.gated_window_agg(samples, Settings(duration=duration).aggregate).withColumn("duration", F.lit(duration))
        for duration in (59, 60)
    ]
    return gated[0].unionByName(gated[1]).select("duration", "target", "window_idx", "n")


def y_limit(spark, sf_dir):
    samples = _in_order(_by_user(spark, sf_dir))
    return windows.y_limit(_twice(samples), INTERVAL).select("target", _round9("y_max"))


def target_summary(spark, sf_dir):
    return summary.target_summary(_by_user(spark, sf_dir)).select(
        "target", "total", "successful", _round9("packet_loss_pct"), _round9("avg_ms"), "min_ms", "max_ms"
    )


def summary_display(spark, sf_dir):
    return summary.summary_display(summary.target_summary(_by_user(spark, sf_dir))).drop("run_id")


def distinct_targets(spark, sf_dir):
    return summary.distinct_targets(_by_user(spark, sf_dir))


def query_max_duration(spark, sf_dir):
    return max_duration(_by_user(spark, sf_dir))


def malformed_audit(spark, sf_dir):
    return summary.malformed_audit(parse_lines(_result_lines(spark, sf_dir))).drop("run_id")


# Derived columns


def sample_index(spark, sf_dir):
    samples = _in_order(_by_user(spark, sf_dir))
    return samples.select("target", "event_id", "seq")


def fill_clip(spark, sf_dir):
    return _twice(_by_user(spark, sf_dir)).select("event_id", fill_and_clip(F.col("latency_ms")).alias("ping_ms"))


def query_zero_fill(spark, sf_dir):
    return _twice(_by_user(spark, sf_dir)).select("event_id", zero_fill(F.col("latency_ms")).alias("live_ms"))


def query_display_value(spark, sf_dir):
    return _twice(_by_user(spark, sf_dir)).select("event_id", display_value(F.col("latency_ms")).alias("shown"))


def query_health_band(spark, sf_dir):
    samples = _in_order(_by_user(spark, sf_dir))
    return live.rolling_max(samples).select("target", "seq", health_band(F.col("window_max")).alias("band"))


def query_live_scale(spark, sf_dir):
    samples = _in_order(_by_user(spark, sf_dir))
    return live.rolling_max(samples).select("target", "seq", live_scale(F.col("window_max")).alias("scale_max"))


def query_segment_index(spark, sf_dir):
    samples = _in_order(_by_user(spark, sf_dir))
    return samples.select("target", "seq", segment_index(F.col("seq"), SEGMENT).alias("segment_idx"))


def parse_samples(spark, sf_dir):
    return parse_lines(_result_lines(spark, sf_dir)).select("event_id", "latency_ms", "malformed")


def query_target_from_name(spark, sf_dir):
    kind = F.col("event_id") % 5
    user = F.col("user_id").cast("string")
    name = (
        F.when(kind == 0, F.concat(F.lit("ping_results_"), user, F.lit(".csv")))
        .when(kind == 1, F.concat(F.lit("results_"), user, F.lit(".txt")))
        .otherwise(F.concat(F.lit("ping_results_10.0.0_"), user, F.lit(".txt")))
    )
    return _events(spark, sf_dir).select("event_id", target_from_name(name).alias("target"))


def query_run_from_path(spark, sf_dir):
    clock = F.date_format("ts", "yyyy-MM-dd_HH-mm-ss")
    folder = F.when(F.col("event_id") % 5 == 0, "by_hand").otherwise(F.concat(F.lit("results_"), clock))
    path = F.concat(F.lit("/data/"), folder, F.lit("/ping_results_"), F.col("user_id"), F.lit(".txt"))
    run_id = run_from_path(path)
    return _events(spark, sf_dir).select("event_id", run_id.alias("run_id"), run_clock(run_id).alias("run_ts"))


def extract_latency(spark, sf_dir):
    value = F.col("value").cast("string")
    output = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Reply from 10.0.0.1: bytes=32 time<"), value, F.lit("ms TTL=50")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("64 bytes: icmp_seq=1 ttl=56 time="), value, F.lit(" ms")))
        .otherwise("Request timed out")
    )
    code = F.when(F.col("event_type") == "error", 1).otherwise(0)
    return _events(spark, sf_dir).select(
        "event_id",
        probe_latency(output, code, "unix").alias("unix_ms"),
        probe_latency(output, code, "windows").alias("windows_ms"),
    )


# Segments and regions


def segment_table(spark, sf_dir):
    return segments.segment_table(measure(_by_user(spark, sf_dir)), SEGMENT)


def segment_labels(spark, sf_dir):
    return segments.segment_titles(segments.segment_table(measure(_by_three(spark, sf_dir)), 600))


def segment_raw(spark, sf_dir):
    samples, extent = _a(spark, sf_dir)
    return segments.segment_raw(samples, SEGMENT, extent).drop("run_id")


def entire_duration(spark, sf_dir):
    samples, extent = _b(spark, sf_dir)
    return segments.segment_raw(samples, None, extent).drop("run_id")


def segment_agg(spark, sf_dir):
    samples, extent = _a(spark, sf_dir)
    return segments.segment_agg(windows.window_agg(samples, INTERVAL), extent, SEGMENT).select(
        "target", "segment_idx", "window_idx", "mid_s", _round9("mean_latency_ms"), _round9("packet_loss_pct")
    )


def empty_segments(spark, sf_dir):
    samples = _by_user(spark, sf_dir)
    return segments.empty_segments(samples, SEGMENT, INTERVAL).drop("run_id")


def _high_a(spark, sf_dir) -> DataFrame:
    samples, extent = _a(spark, sf_dir)
    return regions.high_latency(samples, THRESHOLD, SEGMENT, extent)


def _high_b(spark, sf_dir, segment_len=3600) -> DataFrame:
    samples, extent = _b(spark, sf_dir)
    return regions.high_latency(samples, segment_len=segment_len, extent=extent)


def high_latency(spark, sf_dir):
    return _high_a(spark, sf_dir).drop("run_id")


def high_times_sorted(spark, sf_dir):
    return regions.high_times_sorted(_high_b(spark, sf_dir)).drop("run_id")


def union_high_times(spark, sf_dir):
    short = _high_a(spark, sf_dir)
    long, extent = _b(spark, sf_dir)
    return regions.union_high_times(short, regions.high_latency(long, THRESHOLD, SEGMENT, extent)).drop("run_id")


def regions_all(spark, sf_dir):
    return regions.regions(_high_b(spark, sf_dir)).drop("run_id")


def regions_by_target(spark, sf_dir):
    return regions.regions(_high_a(spark, sf_dir), SEGMENT, by_target=True).drop("run_id")


def regions_entire(spark, sf_dir):
    return regions.regions(_high_b(spark, sf_dir, None), None).drop("run_id")


def regions_padded(spark, sf_dir):
    found = regions.regions(_high_b(spark, sf_dir))
    return regions.pad_regions(found).drop("run_id")


def samples_in_regions(spark, sf_dir):
    samples, extent = _b(spark, sf_dir)
    return regions.samples_in_regions(samples, extent=extent).drop("run_id")


# Live view


def rolling_max_30(spark, sf_dir):
    samples = _in_order(_by_user(spark, sf_dir))
    return live.rolling_max(samples).drop("run_id")


def rolling_buffer(spark, sf_dir):
    samples = _in_order(_by_user(spark, sf_dir))
    return live.rolling_buffer(samples).select("target", F.posexplode("buffer").alias("slot", "live_ms"))


def live_status(spark, sf_dir):
    samples = _in_order(_by_user(spark, sf_dir))
    return live.live_status(samples).drop("run_id")


def tail_n(spark, sf_dir):
    samples = _in_order(_by_user(spark, sf_dir))
    return live.tail_n(samples).select("target", "seq", "event_id", "latency_ms")


# Hosts


def silent_targets(spark, sf_dir):
    expected = spark.read.schema("c_custkey bigint").parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("target"))
    return hosts.silent_targets(expected, _by_user(spark, sf_dir))


def valid_targets(spark, sf_dir):
    key = F.col("c_custkey")
    kind = key % 8
    text = [F.format_string(pattern, *parts) for pattern, *parts in (
        ("%d.%d.%d.%d", key % 300, key % 256, key % 97, key % 255),
        ("0%d.1.1.1", key % 10),
        ("10.%d.1", key % 256),
        ("%x::%x", key, key % 65536),
        ("fe80::%x%%eth0", key),
        ("1:2:3:4:5:6:7:%x:8", key),
        ("::ffff:10.0.%d.%d", key % 270, key % 256),
    )]
    target = F.lit("host name")
    for number, address in enumerate(text):
        target = F.when(kind == number, address).otherwise(target)
    table = spark.read.schema("c_custkey bigint").parquet(f"{sf_dir}/customer.parquet").select("c_custkey", target.alias("target"))
    return hosts.valid_targets(table)


# Text files and stored outputs


RUN = "2024-05-01_12-00-00"


def _run_folder(spark: SparkSession, samples: DataFrame, root: str | None = None) -> str:
    """A run folder as a monitor leaves it: a result file for each target, beside files that are none, and an empty one.

    In a ``root`` given again, files are replaced; with more samples of the same series that is as if lines had been appended.
    """
    root = root or scratch_path(spark, "named")
    folder, parts = f"{root}/results_{RUN}", scratch_path(spark, "parts")
    line = F.coalesce(F.col("latency_ms").cast("string"), F.lit("Lost"))
    # One file for each target: few targets, and files are what this layout has.
    (
        samples.repartition("target")
        .sortWithinPartitions("target", "seq")
        .select("target", line.alias("value"))
        .write.partitionBy("target")
        .text(parts)
    )
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    files = path(parts).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(folder))
    for part in files.globStatus(path(f"{parts}/target=*/part-*")):
        target = part.getPath().getParent().getName().removeprefix("target=")
        files.delete(path(f"{folder}/ping_results_{target}.txt"), False)
        files.rename(part.getPath(), path(f"{folder}/ping_results_{target}.txt"))
    for name in ("other.txt", "ping_results_a.csv"):
        stream = files.create(path(f"{folder}/{name}"))
        stream.write(bytearray(b"1.0\n"))
        stream.close()
    files.create(path(f"{folder}/ping_results_silent.txt")).close()
    return folder


def query_scan_runs(spark, sf_dir):
    return scan_runs(spark, _run_folder(spark, _in_order(_by_three(spark, sf_dir))))


def query_scan_file(spark, sf_dir):
    return scan_file(spark, f"{_run_folder(spark, _in_order(_by_three(spark, sf_dir)))}/ping_results_1.txt")


def query_scan_partitioned(spark, sf_dir):
    samples = _in_order(_by_user(spark, sf_dir))
    path = scratch_path(spark, "runs")
    write_text(samples, path)
    return scan_partitioned(spark, path)


def ingest_twice(spark, sf_dir):
    folder, table = _run_folder(spark, _in_order(_by_three(spark, sf_dir))), scratch_path(spark, "table")
    ingest_runs(spark, table, folder)
    return ingest_runs(spark, table, folder).drop("ts")


def _growing(spark: SparkSession, sf_dir: str, steps: int):
    """A run folder with more and more lines of each file."""
    samples, extent = _b(spark, sf_dir)
    root = scratch_path(spark, "growing")
    for step in range(1, steps + 1):
        yield _run_folder(spark, samples.where(F.col("seq") <= extent.longest * step // steps), root)


def ingest_grown(spark, sf_dir):
    table = scratch_path(spark, "table")
    for folder in _growing(spark, sf_dir, 2):
        stored = ingest_runs(spark, table, folder)
    return stored.drop("ts")


def ingest_two_roots(spark, sf_dir):
    samples, table = _in_order(_by_three(spark, sf_dir)), scratch_path(spark, "table")
    folders = {"home": _run_folder(spark, samples), "office": _run_folder(spark, _twice(samples))}
    for label in ("home", "office", "home"):
        stored = ingest_runs(spark, table, folders[label], label=label)
    return stored.drop("ts")


def sample_clock(spark, sf_dir):
    folder = _run_folder(spark, _in_order(_by_three(spark, sf_dir)))
    return with_clock(scan_runs(spark, folder, label="home"), Settings(ping_interval=5)).drop("malformed")


def _partials_of_growing(spark, sf_dir):
    table = scratch_path(spark, "table")
    for folder in _growing(spark, sf_dir, 3):
        samples = ingest_runs(spark, table, folder)
    return samples, read_partials(spark, table)


def report_from_partials(spark, sf_dir):
    samples, rows = _partials_of_growing(spark, sf_dir)
    return analyse(samples, partials=rows).agg_series.select(
        "target", "segment_idx", "window_idx", "mid_s", _round9("mean_latency_ms"), _round9("packet_loss_pct")
    )


def summary_from_partials(spark, sf_dir):
    samples, rows = _partials_of_growing(spark, sf_dir)
    report = analyse(samples, partials=rows)
    return join_keys(report.summary, report.y_limits, SERIES).select(
        "run_id", "target", "total", "successful", _round9("packet_loss_pct"), _round9("avg_ms"), "min_ms", "max_ms", _round9("y_max")
    )


def samples_in_stored_regions(spark, sf_dir):
    samples, extent = _b(spark, sf_dir)
    path = scratch_path(spark, "report")
    write_part(analyse(samples, extent=extent).regions, path)
    stored = read_segments(spark, path, "run_id string, segment_idx bigint, start_s bigint, end_s bigint, is_first boolean")
    others, size = _a(spark, sf_dir)
    found = regions.samples_in(others, stored, size)
    return found.select("target", "seq", "latency_ms", "segment_idx", "start_s", "end_s", "is_first")


def rolling_max_300(spark, sf_dir):
    return live.rolling_max(_in_order(_by_three(spark, sf_dir)), 300).drop("run_id")


def _customers(spark, sf_dir):
    return spark.read.schema("c_custkey bigint").parquet(f"{sf_dir}/customer.parquet")


def silent_by_run(spark, sf_dir):
    expected = _customers(spark, sf_dir).select(F.col("c_custkey").cast("string").alias("target"))
    run = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("run"), (F.col("event_id") % 3).cast("string")))
    samples = _by_user(spark, sf_dir).withColumn("run_id", run)
    return hosts.silent_in_runs(expected, samples)


def host_check(spark, sf_dir):
    key = F.col("c_custkey")
    target = F.when(key % 4 == 0, F.concat(F.lit("10.0.0."), key % 300)).when(key % 4 == 1, F.format_string("fe80::%x", key))
    target = target.when(key % 4 == 2, F.lit("host name"))
    checked = hosts.check_hosts(_customers(spark, sf_dir).select("c_custkey", target.alias("target")))
    return checked.withColumn("version", F.col("version").cast("string"))


def _stored_part(spark, part: DataFrame) -> DataFrame:
    path = scratch_path(spark, "report")
    write_part(part, path)
    return read_segments(spark, path, part.schema)


def stored_regions(spark, sf_dir):
    samples, extent = _b(spark, sf_dir)
    return _stored_part(spark, analyse(samples, extent=extent).regions)


def _report_b(spark, sf_dir, expected: DataFrame | None = None):
    samples, extent = _b(spark, sf_dir)
    return analyse(samples, extent=extent, expected=expected)


def stored_segments(spark, sf_dir):
    return _stored_part(spark, _report_b(spark, sf_dir).segments)


def stored_agg_series(spark, sf_dir):
    return _stored_part(spark, _report_b(spark, sf_dir).agg_series).select(
        "target", "segment_idx", "window_idx", "mid_s", _round9("mean_latency_ms"), _round9("packet_loss_pct")
    )


def stored_y_limits(spark, sf_dir):
    return _stored_part(spark, _report_b(spark, sf_dir).y_limits).select("target", _round9("y_max"))


def stored_silent(spark, sf_dir):
    expected = _customers(spark, sf_dir).select(F.col("c_custkey").cast("string").alias("target"))
    return _stored_part(spark, _report_b(spark, sf_dir, expected).silent)


def ingest_ledger(spark, sf_dir):
    """What the ledger has of each file after its lines came in three steps."""
    table = scratch_path(spark, "table")
    for folder in _growing(spark, sf_dir, 3):
        ingest_runs(spark, table, folder)
    return ledger(spark, table).select("run_id", "target", "lines", "ended")


def stored_summary(spark, sf_dir):
    return _stored_part(spark, analyse(_in_order(_by_user(spark, sf_dir))).summary_text).drop("run_id")


def stored_malformed(spark, sf_dir):
    samples = with_seq(parse_lines(_result_lines(spark, sf_dir)), ["event_id"])
    return _stored_part(spark, analyse(samples).malformed).drop("run_id")


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several runs, one of them NULL, and targets of which one is NULL and one empty."""
    target = F.when(F.col("user_id") % 5 == 0, F.lit(None)).when(F.col("user_id") % 5 == 1, "").otherwise(
        (F.col("user_id") % 5).cast("string")
    )
    run = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("run"), (F.col("event_id") % 3).cast("string")))
    samples = _events(spark, sf_dir).select(
        run.alias("run_id"),
        target.alias("target"),
        "ts",
        "event_id",
        F.when(F.col("event_type") != "error", F.col("value")).alias("latency_ms"),
    )
    return _in_order(samples)


def null_keys(spark, sf_dir):
    inside = segments.segment_raw(_keyed(spark, sf_dir), SEGMENT)
    return inside.groupBy("run_id", "target", "segment_idx").agg(
        F.count("*").alias("n"), F.sum("seq").alias("positions"), F.round(F.max("ping_ms"), 9).alias("top_ms")
    )


def regions_null_keys(spark, sf_dir):
    samples = _keyed(spark, sf_dir)
    high = regions.high_latency(samples, THRESHOLD, SEGMENT)
    return regions.regions(high, SEGMENT, by_target=True)


def sink_text_roundtrip(spark, sf_dir):
    samples = _in_order(_by_user(spark, sf_dir))
    path = scratch_path(spark, "text")
    write_text(samples, path)
    return read_lines(spark, path).groupBy("run_id", "target", "value").agg(F.count("*").alias("n_lines"))


def sink_text_appended(spark, sf_dir):
    samples = _in_order(_by_user(spark, sf_dir))
    path = scratch_path(spark, "text")
    for first, last in ((0, 20), (20, 45), (45, 2**40)):
        write_text(samples.where(F.col("seq").between(first + 1, last)).withColumn("seq", F.col("seq") - first), path)
    return scan_partitioned(spark, path)


def sink_segments_roundtrip(spark, sf_dir):
    table, path = scratch_path(spark, "table"), scratch_path(spark, "report")
    write_samples(_in_order(_by_three(spark, sf_dir)).withColumn("malformed", F.lit(False)), table)
    write_report(analyse(read_samples(spark, table)), path)
    series = "target string, seq bigint, ping_ms double, run_id string, segment_idx bigint"
    return read_segments(spark, f"{path}/raw_series", series)


# Streams: each query runs to the end of its input, then reads what it stored.


def _user_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # A pattern, because a stream may read a folder or what a pattern matches but not one named file.
    stream = streams.event_stream(spark, f"{sf_dir}/event[s].parquet")
    return events_as_samples(stream, F.col("user_id")).withColumn("ts", F.col("ts").cast("timestamp"))


def _stored(spark: SparkSession, stream: DataFrame, name: str, start=streams.store) -> DataFrame:
    path = scratch_path(spark, name)
    streams.run_to_end(start(stream, path, every=None))
    return spark.read.schema(stream.schema).parquet(path)


def stream_samples(spark, sf_dir):
    samples = _in_order(_by_user(spark, sf_dir))
    landing = scratch_path(spark, "landing")
    write_text(samples, landing)
    return _stored(spark, streams.partitioned_stream(spark, landing), "samples").drop("run_id")


def stream_live_status(spark, sf_dir):
    updates = _stored(spark, live_streams.live_updates(_user_stream(spark, sf_dir), "event_id"), "live")
    return streams.newest(updates, ["target"], "seq").drop("run_id")


def stream_window_agg(spark, sf_dir):
    closed = _stored(spark, live_streams.time_windows(_user_stream(spark, sf_dir), "1 day", "1 hour"), "windows")
    return closed.select(
        "target",
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        "n",
        "lost",
        _round9("mean_latency_ms"),
        _round9("packet_loss_pct"),
    )


def stream_summary(spark, sf_dir):
    running = live_streams.summary_updates(_user_stream(spark, sf_dir))
    updates = _stored(spark, running, "summary", streams.store_updates).drop("batch")
    return streams.newest(updates, ["target"], "total").select(
        "target", "total", "successful", _round9("packet_loss_pct"), _round9("avg_ms"), "min_ms", "max_ms"
    )


def stream_appended(spark, sf_dir):
    """Lines appended between three runs of one query, which goes on from its checkpoint each time."""
    state, table, checkpoint = (scratch_path(spark, name) for name in ("sizes", "table", "checkpoint"))
    for folder in _growing(spark, sf_dir, 3):
        lines = appended_stream(spark, folder, state)
        streams.run_to_end(streams.store_appended(lines, table, checkpoint, every=None))
    return read_samples(spark, table).drop("ts")


def stream_landed_samples(spark, sf_dir):
    landing = scratch_path(spark, "landing")
    samples = _in_order(_by_user(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp"))
    write_samples(samples.withColumn("malformed", F.col("latency_ms").isNull()).select(*SAMPLES.names), landing)
    stored = _stored(spark, streams.sample_stream(spark, landing, max_files=2), "samples")
    return stored.select("run_id", "target", "seq", "latency_ms", "malformed")


def stream_result_lines(spark, sf_dir):
    folder = _run_folder(spark, _in_order(_by_three(spark, sf_dir)))
    return _stored(spark, streams.result_stream(spark, folder, max_files=1), "lines")


def stream_runs_closed(spark, sf_dir):
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    closed = _stored(spark, live_streams.closed_runs(_user_stream(spark, sf_dir), "8 hours", "1 hour"), "closed")
    return closed.select(
        "target",
        F.col("from_ts").cast("timestamp_ntz").alias("from_ts"),
        F.col("to_ts").cast("timestamp_ntz").alias("to_ts"),
        "total", "successful", _round9("packet_loss_pct"), _round9("avg_ms"), "min_ms", "max_ms",
    )


def _file_by_file(spark, sf_dir, late: bool = False) -> DataFrame:
    """Samples as a stream of six files, one in a batch; some without a time if ``late``."""
    folder = scratch_path(spark, "landed")
    _events(spark, sf_dir).repartition(6, "event_id").write.parquet(folder)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    samples = events_as_samples(streams.event_stream(spark, folder, max_files=1), F.col("user_id"))
    ts = F.col("ts").cast("timestamp")
    return samples.withColumn("ts", F.when(F.col("event_id") % 11 != 0, ts) if late else ts)


def stream_newest_merged(spark, sf_dir):
    """Updates of six batches, merged after every two."""
    running, path = live_streams.summary_updates(_file_by_file(spark, sf_dir)), scratch_path(spark, "updates")
    merged_by = (["run_id", "target"], "total")
    streams.run_to_end(streams.store_updates(running, path, every=None, merged_by=merged_by, merge_every=2))
    return updates.read_newest(spark, path, running.schema, *merged_by).select(
        "target", "total", "successful", _round9("packet_loss_pct"), _round9("avg_ms"), "min_ms", "max_ms"
    )


def stream_live_files(spark, sf_dir):
    """Live status over several batches, with samples that have no time and come before all others."""
    statuses = _stored(spark, live_streams.live_updates(_file_by_file(spark, sf_dir, late=True), "event_id"), "live")
    return streams.newest(statuses, ["target"], "seq").drop("run_id")


def stream_sink_roundtrip(spark, sf_dir):
    stored = _stored(spark, _user_stream(spark, sf_dir), "sink", streams.store_samples)
    return stored.select("target", "event_id", "latency_ms")


def _corpus() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries on text corpora and their SQL, where that subpackage and what it needs can be imported."""
    try:
        import corpus_pipeline
        from hoplens.llm import queries as corpus
    except ImportError:
        return {}, {}
    sql = corpus.SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
    return corpus.QUERIES | {"pipeline": corpus_pipeline.run}, sql


def queries() -> dict[str, Query]:
    return _latency_queries() | _corpus()[0]


def oracle_sql() -> dict[str, str]:
    return _latency_sql() | _corpus()[1]


def _latency_queries() -> dict[str, Query]:
    return {
        "window_agg_60": window_agg_60,
        "window_agg_10": window_agg_10,
        "window_agg_repair": window_agg_repair,
        "all_lost_windows": all_lost_windows,
        "window_head": window_head,
        "agg_gate": agg_gate,
        "y_limit": y_limit,
        "target_summary": target_summary,
        "summary_display": summary_display,
        "distinct_targets": distinct_targets,
        "max_duration": query_max_duration,
        "malformed_audit": malformed_audit,
        "sample_index": sample_index,
        "fill_clip": fill_clip,
        "zero_fill": query_zero_fill,
        "display_value": query_display_value,
        "health_band": query_health_band,
        "live_scale": query_live_scale,
        "segment_index": query_segment_index,
        "parse_samples": parse_samples,
        "target_from_name": query_target_from_name,
        "run_from_path": query_run_from_path,
        "extract_latency": extract_latency,
        "segment_table": segment_table,
        "segment_labels": segment_labels,
        "segment_raw": segment_raw,
        "entire_duration": entire_duration,
        "segment_agg": segment_agg,
        "empty_segments": empty_segments,
        "high_latency": high_latency,
        "high_times_sorted": high_times_sorted,
        "union_high_times": union_high_times,
        "regions_all": regions_all,
        "regions_by_target": regions_by_target,
        "regions_entire": regions_entire,
        "regions_padded": regions_padded,
        "samples_in_regions": samples_in_regions,
        "rolling_max_30": rolling_max_30,
        "rolling_buffer": rolling_buffer,
        "live_status": live_status,
        "tail_n": tail_n,
        "silent_targets": silent_targets,
        "valid_targets": valid_targets,
        "scan_runs": query_scan_runs,
        "scan_file": query_scan_file,
        "scan_partitioned": query_scan_partitioned,
        "ingest_twice": ingest_twice,
        "null_keys": null_keys,
        "regions_null_keys": regions_null_keys,
        "sink_text_roundtrip": sink_text_roundtrip,
        "sink_segments_roundtrip": sink_segments_roundtrip,
        "stream_samples": stream_samples,
        "stream_live_status": stream_live_status,
        "stream_window_agg": stream_window_agg,
        "stream_summary": stream_summary,
        "stream_sink_roundtrip": stream_sink_roundtrip,
        "stream_appended": stream_appended,
        "stream_landed_samples": stream_landed_samples,
        "stream_result_lines": stream_result_lines,
        "stream_runs_closed": stream_runs_closed,
        "stream_newest_merged": stream_newest_merged,
        "stream_live_files": stream_live_files,
        "ingest_grown": ingest_grown,
        "ingest_two_roots": ingest_two_roots,
        "sample_clock": sample_clock,
        "report_from_partials": report_from_partials,
        "summary_from_partials": summary_from_partials,
        "samples_in_stored_regions": samples_in_stored_regions,
        "rolling_max_300": rolling_max_300,
        "silent_by_run": silent_by_run,
        "host_check": host_check,
        "stored_regions": stored_regions,
        "stored_segments": stored_segments,
        "stored_agg_series": stored_agg_series,
        "stored_y_limits": stored_y_limits,
        "stored_silent": stored_silent,
        "stored_summary": stored_summary,
        "ingest_ledger": ingest_ledger,
        "stored_malformed": stored_malformed,
        "sink_text_appended": sink_text_appended,
    }


# SQL

LATENCY = "CASE WHEN event_type <> 'error' THEN value END"


def _series(target: str, latency: str = LATENCY) -> str:
    """Numbered samples as ``s`` and the length of the longest series as ``m``."""
    return f"""
        s AS (
            SELECT CAST({target} AS VARCHAR) AS target, event_id,
                   row_number() OVER (PARTITION BY {target} ORDER BY ts, event_id) AS seq,
                   {latency} AS latency_ms
            FROM events),
        m AS (SELECT max(seq) AS max_seq FROM s)"""


A = "WITH" + _series("user_id")
B = "WITH" + _series("user_id % 3")


#: Samples of several runs in segments, with NULL and empty keys, as ``r``.
KEYED = f"""WITH k AS (
        SELECT CASE WHEN event_id % 3 > 0 THEN 'run' || CAST(event_id % 3 AS VARCHAR) END AS run_id,
               CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE CAST(user_id % 5 AS VARCHAR) END AS target,
               ts, event_id, {LATENCY} AS latency_ms
        FROM events),
    s AS (SELECT *, row_number() OVER (PARTITION BY run_id, target ORDER BY ts, event_id) AS seq FROM k),
    m AS (SELECT run_id, max(seq) AS max_seq FROM s GROUP BY run_id),
    r AS (SELECT s.run_id, target, seq // {SEGMENT} AS segment_idx, seq, least(coalesce(latency_ms, 800.0), 800.0) AS ping_ms
          FROM s JOIN m ON s.run_id IS NOT DISTINCT FROM m.run_id WHERE seq < max_seq)"""


def _windows_sql(series: str, interval: int, where: str = "true", mean: str = "coalesce(avg(latency_ms), 0.0)") -> str:
    return f"""{series}
        SELECT target, (seq - 1) // {interval} AS window_idx,
               (seq - 1) // {interval} * {interval} + count(*) / 2.0::DOUBLE AS mid_s,
               count(*) AS n, count(*) - count(latency_ms) AS lost,
               round({mean}, 9) AS mean_latency_ms,
               round((count(*) - count(latency_ms))::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE, 9) AS packet_loss_pct
        FROM s GROUP BY target, (seq - 1) // {interval} HAVING {where}"""


def _in_segments(series: str, segment_len: int | None) -> str:
    segment = "0::BIGINT" if segment_len is None else f"seq // {segment_len}"
    return f"""{series},
        r AS (SELECT target, {segment} AS segment_idx, seq,
                     least(coalesce(latency_ms, 800.0), 800.0) AS ping_ms
              FROM s, m WHERE seq < max_seq)"""


def _regions_sql(series: str, segment_len: int | None, threshold: float, keys: str) -> str:
    return f"""{_in_segments(series, segment_len)},
        t AS (SELECT DISTINCT {keys}, seq FROM r WHERE ping_ms > {threshold}),
        i AS (SELECT *, seq - row_number() OVER (PARTITION BY {keys} ORDER BY seq) AS island FROM t),
        g AS (SELECT {keys}, min(seq) AS start_s, max(seq) AS end_s FROM i GROUP BY {keys}, island)"""


SUMMARY = f"""
    SELECT CAST(user_id AS VARCHAR) AS target, count(*) AS total, count({LATENCY}) AS successful,
           (count(*) - count({LATENCY}))::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE AS packet_loss_pct,
           avg({LATENCY}) AS avg_ms, min({LATENCY}) AS min_ms, max({LATENCY}) AS max_ms
    FROM events GROUP BY user_id"""

ROUNDED_SUMMARY = f"""
    SELECT target, total, successful, round(packet_loss_pct, 9) AS packet_loss_pct, round(avg_ms, 9) AS avg_ms,
           min_ms, max_ms
    FROM ({SUMMARY})"""

ROLLING = f"""{A},
    v AS (SELECT target, seq, latency_ms, coalesce(latency_ms, 0.0) AS live_ms,
                 max(coalesce(latency_ms, 0.0)) OVER (
                     PARTITION BY target ORDER BY seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS top
          FROM s),
    w AS (SELECT target, seq, latency_ms, live_ms,
                 CASE WHEN seq < 30 THEN greatest(top, 0.0) ELSE top END AS window_max
          FROM v)"""

BAND = "CASE WHEN window_max < 75 THEN 'green' WHEN window_max < 125 THEN 'yellow' ELSE 'red' END"

LIVE = f"""{ROLLING}
    SELECT target, seq,
           CASE WHEN latency_ms IS NULL THEN 'Lost' ELSE least(latency_ms, 800.0)::VARCHAR || ' ms' END AS latest,
           window_max, greatest(window_max, 100.0) AS scale_max, {BAND} AS band
    FROM w QUALIFY row_number() OVER (PARTITION BY target ORDER BY seq DESC) = 1"""

#: A with times missing, which come first.
A_LATE = A.replace("ORDER BY ts, event_id", "ORDER BY CASE WHEN event_id % 11 <> 0 THEN ts END NULLS FIRST, event_id")

DOUBLED = "CASE WHEN event_type <> 'error' THEN value * 2 END"

LINE_KINDS = """
    SELECT event_id, user_id,
           CASE event_id % 8
               WHEN 4 THEN value
               WHEN 5 THEN CAST(CAST(value AS VARCHAR) || 'e1' AS DOUBLE)
               WHEN 6 THEN CAST('10' || CAST(value AS VARCHAR) AS DOUBLE)
               WHEN 7 THEN value
           END AS latency_ms,
           event_id % 8 IN (0, 1, 3) AS malformed
    FROM events"""


def _summary_sql(target: str) -> str:
    return SUMMARY.replace("user_id", target)


def _segment_agg_sql(series: str, segment: int, interval: int) -> str:
    return f"""{_in_segments(series, segment)},
            w AS (SELECT target, (seq - 1) // {interval} AS window_idx,
                         (seq - 1) // {interval} * {interval} + count(*) / 2.0::DOUBLE AS mid_s,
                         round(coalesce(avg(latency_ms), 0.0), 9) AS mean_latency_ms,
                         round((count(*) - count(latency_ms))::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE, 9)
                             AS packet_loss_pct
                  FROM s GROUP BY target, (seq - 1) // {interval}),
            p AS (SELECT *, CAST(floor(mid_s) AS BIGINT) // {segment} AS segment_idx FROM w)
            SELECT target, segment_idx, window_idx, mid_s, mean_latency_ms, packet_loss_pct
            FROM p, m
            WHERE mid_s < max_seq AND (target, segment_idx) IN (SELECT target, segment_idx FROM r)"""


def _y_limit_sql(series: str, interval: int) -> str:
    return f"""{series},
            w AS (SELECT target, max(latency_ms) AS peak, coalesce(avg(latency_ms), 0.0) AS mean
                  FROM s GROUP BY target, (seq - 1) // {interval})
            SELECT target, round(CASE WHEN max(peak) IS NULL THEN NULL
                                      WHEN greatest(max(peak), max(mean)) > 800 THEN 800.0::DOUBLE
                                      ELSE greatest(max(peak), max(mean)) * 1.05::DOUBLE END, 9) AS y_max
            FROM w GROUP BY target"""


def _latency_sql() -> dict[str, str]:
    return {
        "window_agg_60": _windows_sql(B, 60),
        "window_agg_10": _windows_sql(A, 10),
        "window_agg_repair": _windows_sql(
            "WITH" + _series("user_id", f"CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE ELSE {LATENCY} END"),
            5,
            mean="CASE WHEN bool_or(isnan(latency_ms)) THEN 0.0 ELSE coalesce(avg(latency_ms), 0.0) END",
        ),
        "all_lost_windows": _windows_sql(A, 3, where="count(latency_ms) = 0"),
        "window_head": _windows_sql(A, 10, where="(seq - 1) // 10 < 5"),
        "agg_gate": f"""{B}
            SELECT 60::INTEGER AS duration, target, (seq - 1) // 60 AS window_idx, count(*) AS n
            FROM s GROUP BY target, (seq - 1) // 60""",
        "y_limit": _y_limit_sql("WITH" + _series("user_id", DOUBLED), 10),
        "target_summary": ROUNDED_SUMMARY,
        "summary_display": f"""
            SELECT target, total::VARCHAR AS total_pings, successful::VARCHAR AS successful_pings,
                   printf('%.2f%%', packet_loss_pct) AS packet_loss,
                   coalesce(printf('%.2f', avg_ms), 'N/A') AS average_latency,
                   coalesce(printf('%.2f', min_ms), 'N/A') AS min_latency,
                   coalesce(printf('%.2f', max_ms), 'N/A') AS max_latency
            FROM ({SUMMARY})""",
        "distinct_targets": "SELECT DISTINCT 'events' AS run_id, CAST(user_id AS VARCHAR) AS target FROM events",
        "max_duration": """
            SELECT 'events' AS run_id, max(n) AS max_seq
            FROM (SELECT count(*) AS n FROM events GROUP BY user_id)""",
        "malformed_audit": f"""
            SELECT CAST(user_id AS VARCHAR) AS target, count(*) AS n_lines,
                   count(*) FILTER (malformed) AS n_malformed
            FROM ({LINE_KINDS}) GROUP BY user_id""",
        "sample_index": f"{A} SELECT target, event_id, seq FROM s",
        "fill_clip": f"SELECT event_id, least(coalesce({DOUBLED}, 800.0), 800.0) AS ping_ms FROM events",
        "zero_fill": f"SELECT event_id, coalesce({DOUBLED}, 0.0) AS live_ms FROM events",
        "display_value": f"""
            SELECT event_id, coalesce(CAST(least({DOUBLED}, CASE WHEN event_type <> 'error' THEN 800.0::DOUBLE END)
                                      AS VARCHAR) || ' ms', 'Lost') AS shown
            FROM events""",
        "health_band": f"{ROLLING} SELECT target, seq, {BAND} AS band FROM w",
        "live_scale": f"{ROLLING} SELECT target, seq, greatest(window_max, 100.0) AS scale_max FROM w",
        "segment_index": f"{A} SELECT target, seq, seq // 20 AS segment_idx FROM s",
        "parse_samples": f"SELECT event_id, latency_ms, malformed FROM ({LINE_KINDS})",
        "target_from_name": """
            SELECT event_id, CASE WHEN event_id % 5 > 1 THEN '10.0.0_' || CAST(user_id AS VARCHAR) END AS target
            FROM events""",
        "run_from_path": """
            SELECT event_id,
                   CASE WHEN event_id % 5 = 0 THEN 'by_hand' ELSE strftime(ts, '%Y-%m-%d_%H-%M-%S') END AS run_id,
                   CASE WHEN event_id % 5 <> 0 THEN date_trunc('second', ts)::TIMESTAMP END AS run_ts
            FROM events""",
        "extract_latency": """
            SELECT event_id,
                   CASE WHEN event_type <> 'error' AND event_id % 3 = 1 THEN value END AS unix_ms,
                   CASE WHEN event_type <> 'error' AND event_id % 3 = 0 THEN value END AS windows_ms
            FROM events""",
        "segment_table": f"""{A}
            SELECT 'events' AS run_id, k AS segment_idx, k * 20 AS start_s, least(k * 20 + 20, max_seq) AS end_s,
                   'hour_' || CAST(k + 1 AS VARCHAR) AS segment_label
            FROM (SELECT max_seq, unnest(range(0, (max_seq - 1) // 20 + 1)) AS k FROM m)""",
        "segment_labels": f"""{B},
            k AS (SELECT max_seq, unnest(range(0, (max_seq - 1) // 600 + 1)) AS segment_idx FROM m),
            e AS (SELECT segment_idx, segment_idx * 600 AS start_s, least(segment_idx * 600 + 600, max_seq) AS end_s
                  FROM k)
            SELECT 'events' AS run_id, segment_idx, start_s, end_s,
                   'hour_' || CAST(segment_idx + 1 AS VARCHAR) AS segment_label,
                   printf('Hour %d (%d:%02d:%02d to %d:%02d:%02d)', segment_idx + 1,
                          start_s // 3600, start_s % 3600 // 60, start_s % 60,
                          end_s // 3600, end_s % 3600 // 60, end_s % 60) AS title
            FROM e""",
        "segment_raw": f"{_in_segments(A, 20)} SELECT * FROM r",
        "entire_duration": f"{_in_segments(B, None)} SELECT * FROM r",
        "segment_agg": _segment_agg_sql(A, 20, 10),
        "empty_segments": f"""{_in_segments(A, 20)},
            k AS (SELECT unnest(range(0, (max_seq - 1) // 20 + 1)) AS segment_idx FROM m),
            h AS (SELECT DISTINCT target FROM s),
            w AS (SELECT target, (seq - 1) // 10 * 10 + count(*) / 2.0::DOUBLE AS mid_s
                  FROM s GROUP BY target, (seq - 1) // 10),
            g AS (SELECT DISTINCT target, CAST(floor(mid_s) AS BIGINT) // 20 AS segment_idx FROM w),
            d AS (SELECT DISTINCT target, segment_idx FROM r)
            SELECT target, segment_idx, 'raw' AS series FROM h, k
            WHERE (target, segment_idx) NOT IN (SELECT target, segment_idx FROM d)
            UNION ALL
            SELECT target, segment_idx, 'aggregated' AS series FROM d
            WHERE (target, segment_idx) NOT IN (SELECT target, segment_idx FROM g)""",
        "high_latency": f"{_in_segments(A, 20)} SELECT * FROM r WHERE ping_ms > 100",
        "high_times_sorted": f"""{_in_segments(B, 3600)}
            SELECT DISTINCT segment_idx, seq FROM r WHERE ping_ms > 200 ORDER BY segment_idx, seq""",
        "union_high_times": f"""
            SELECT * FROM ({_in_segments(A, 20)} SELECT target, segment_idx, seq FROM r WHERE ping_ms > 100)
            UNION ALL
            SELECT * FROM ({_in_segments(B, 20)} SELECT target, segment_idx, seq FROM r WHERE ping_ms > 100)""",
        "regions_all": f"{_regions_sql(B, 3600, 200, 'segment_idx')} SELECT * FROM g",
        "regions_by_target": f"{_regions_sql(A, 20, 100, 'target, segment_idx')} SELECT * FROM g",
        "regions_entire": f"{_regions_sql(B, None, 200, 'segment_idx')} SELECT * FROM g",
        "regions_padded": f"""{_regions_sql(B, 3600, 200, 'segment_idx')}
            SELECT segment_idx, start_s, end_s,
                   start_s = min(start_s) OVER (PARTITION BY segment_idx) AS is_first,
                   start_s - 0.5::DOUBLE AS pad_start, end_s + 0.5::DOUBLE AS pad_end
            FROM g""",
        "samples_in_regions": f"""{_regions_sql(B, 3600, 200, 'segment_idx')}
            SELECT r.target, r.segment_idx, r.seq, r.ping_ms, g.start_s, g.end_s
            FROM r JOIN g ON r.segment_idx = g.segment_idx AND r.seq BETWEEN g.start_s - 0.5 AND g.end_s + 0.5""",
        "rolling_max_30": f"{ROLLING} SELECT target, seq, live_ms, window_max FROM w",
        "rolling_buffer": f"""{A},
            n AS (SELECT target, max(seq) AS n FROM s GROUP BY target),
            z AS (SELECT target, n, unnest(range(0, 30)) AS slot FROM n)
            SELECT z.target, CAST(slot AS INTEGER) AS slot, coalesce(latency_ms, 0.0) AS live_ms
            FROM z LEFT JOIN s ON s.target = z.target AND s.seq = n - 29 + slot""",
        "live_status": LIVE,
        "tail_n": f"""{A}
            SELECT target, seq, event_id, latency_ms FROM s
            QUALIFY row_number() OVER (PARTITION BY target ORDER BY seq DESC) <= 30""",
        "silent_targets": """
            SELECT CAST(c_custkey AS VARCHAR) AS target FROM customer
            WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)""",
        "valid_targets": """
            SELECT c_custkey, CASE c_custkey % 8
                       WHEN 0 THEN printf('%d.%d.%d.%d', c_custkey % 300, c_custkey % 256, c_custkey % 97, c_custkey % 255)
                       WHEN 3 THEN printf('%x::%x', c_custkey, c_custkey % 65536)
                       WHEN 4 THEN printf('fe80::%x', c_custkey) || '%eth0'
                       WHEN 6 THEN printf('::ffff:10.0.%d.%d', c_custkey % 270, c_custkey % 256) END AS target
            FROM customer
            WHERE (c_custkey % 8 = 0 AND c_custkey % 300 < 256) OR (c_custkey % 8 IN (3, 4) AND c_custkey < 65536)
               OR (c_custkey % 8 = 6 AND c_custkey % 270 < 256)""",
        "scan_runs": f"""{B}
            SELECT '{RUN}' AS run_id, target, seq, latency_ms, false AS malformed, TIMESTAMP '2024-05-01 12:00:00' AS run_ts FROM s""",
        "scan_file": f"""{B}
            SELECT '{RUN}' AS run_id, target, seq, latency_ms, false AS malformed FROM s WHERE target = '1'""",
        "scan_partitioned": f"""{A}
            SELECT 'events' AS run_id, target, seq, latency_ms, false AS malformed FROM s""",
        "ingest_twice": f"""{B}
            SELECT '{RUN}' AS run_id, target, seq, latency_ms, false AS malformed FROM s""",
        "null_keys": f"""{KEYED}
            SELECT run_id, target, segment_idx, count(*) AS n, CAST(sum(seq) AS BIGINT) AS positions, round(max(ping_ms), 9) AS top_ms
            FROM r GROUP BY run_id, target, segment_idx""",
        "regions_null_keys": f"""{KEYED},
            i AS (SELECT *, seq - row_number() OVER (PARTITION BY run_id, target, segment_idx ORDER BY seq) AS island
                  FROM r WHERE ping_ms > {THRESHOLD})
            SELECT run_id, target, segment_idx, min(seq) AS start_s, max(seq) AS end_s
            FROM i GROUP BY run_id, target, segment_idx, island""",
        "sink_text_roundtrip": f"""
            SELECT 'events' AS run_id, CAST(user_id AS VARCHAR) AS target,
                   coalesce(CAST({LATENCY} AS VARCHAR), 'Lost') AS value, count(*) AS n_lines
            FROM events GROUP BY ALL""",
        "sink_segments_roundtrip": f"""{_in_segments(B, 3600)}
            SELECT 'events' AS run_id, target, segment_idx, seq, ping_ms FROM r""",
        "stream_samples": f"""
            SELECT CAST(user_id AS VARCHAR) AS target, {LATENCY} AS latency_ms, false AS malformed FROM events""",
        "stream_live_status": LIVE,
        "stream_window_agg": f"""
            SELECT CAST(user_id AS VARCHAR) AS target, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n,
                   count(*) - count({LATENCY}) AS lost, round(coalesce(avg({LATENCY}), 0.0), 9) AS mean_latency_ms,
                   round((count(*) - count({LATENCY}))::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE, 9) AS packet_loss_pct
            FROM events
            WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
            GROUP BY user_id, date_trunc('day', ts)""",
        "stream_summary": ROUNDED_SUMMARY,
        "stream_sink_roundtrip": f"""
            SELECT CAST(user_id AS VARCHAR) AS target, event_id, {LATENCY} AS latency_ms FROM events""",
        "stream_appended": f"""{B}
            SELECT '{RUN}' AS run_id, target, seq, latency_ms, false AS malformed FROM s""",
        "stream_landed_samples": f"""{A}
            SELECT 'events' AS run_id, target, seq, latency_ms, latency_ms IS NULL AS malformed FROM s""",
        "stream_result_lines": f"""{B}
            SELECT '{RUN}' AS run_id, target, latency_ms, false AS malformed FROM s""",
        "stream_runs_closed": f"""
            WITH s AS (
                SELECT CAST(user_id AS VARCHAR) AS target, ts, event_id, {LATENCY} AS latency_ms,
                       coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 8 HOUR, true) AS starts
                FROM events),
            g AS (SELECT *, count(*) FILTER (starts) OVER (PARTITION BY target ORDER BY ts, event_id) AS stretch FROM s)
            SELECT target, min(ts) AS from_ts, max(ts) AS to_ts, count(*) AS total, count(latency_ms) AS successful,
                   round((count(*) - count(latency_ms))::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE, 9) AS packet_loss_pct,
                   round(avg(latency_ms), 9) AS avg_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms
            FROM g GROUP BY target, stretch
            HAVING max(ts) + INTERVAL 9 HOUR <= (SELECT max(ts) FROM events)""",
        "stream_newest_merged": ROUNDED_SUMMARY,
        "stream_live_files": LIVE.replace(A, A_LATE),
        "ingest_grown": f"""{B}
            SELECT '{RUN}' AS run_id, target, seq, latency_ms, false AS malformed FROM s""",
        "ingest_two_roots": f"""{B}
            SELECT 'home/{RUN}' AS run_id, target, seq, latency_ms, false AS malformed FROM s
            UNION ALL
            SELECT 'office/{RUN}' AS run_id, target, seq, latency_ms * 2 AS latency_ms, false AS malformed FROM s""",
        "sample_clock": f"""{B}
            SELECT 'home/{RUN}' AS run_id, target, seq, latency_ms, TIMESTAMP '2024-05-01 12:00:00' AS run_ts, seq * 5 AS elapsed_s,
                   TIMESTAMP '2024-05-01 12:00:00' + to_seconds((seq - 1) * 5) AS probe_ts
            FROM s""",
        "report_from_partials": _segment_agg_sql(B, 3600, 60),
        "summary_from_partials": f"""
            SELECT '{RUN}' AS run_id, target, total, successful, round(packet_loss_pct, 9) AS packet_loss_pct,
                   round(avg_ms, 9) AS avg_ms, min_ms, max_ms, y_max
            FROM ({_summary_sql("(user_id % 3)")}) JOIN ({_y_limit_sql(B, 60)}) USING (target)""",
        "samples_in_stored_regions": f"""
            SELECT s.target, seq, latency_ms, segment_idx, start_s, end_s,
                   start_s = min(start_s) OVER (PARTITION BY segment_idx) AS is_first
            FROM ({A} SELECT target, seq, latency_ms FROM s) s
            JOIN ({_regions_sql(B, 3600, 200, 'segment_idx')} SELECT * FROM g) g ON s.seq BETWEEN g.start_s AND g.end_s""",
        "rolling_max_300": f"""{B},
            v AS (SELECT target, seq, coalesce(latency_ms, 0.0) AS live_ms, max(coalesce(latency_ms, 0.0)) OVER (
                      PARTITION BY target ORDER BY seq ROWS BETWEEN 299 PRECEDING AND CURRENT ROW) AS top FROM s)
            SELECT target, seq, live_ms, CASE WHEN seq < 300 THEN greatest(top, 0.0) ELSE top END AS window_max FROM v""",
        "silent_by_run": """
            WITH s AS (SELECT DISTINCT CASE WHEN event_id % 3 > 0 THEN 'run' || CAST(event_id % 3 AS VARCHAR) END AS run_id,
                              CAST(user_id AS VARCHAR) AS target FROM events),
            e AS (SELECT run_id, CAST(c_custkey AS VARCHAR) AS target FROM customer, (SELECT DISTINCT run_id FROM s))
            SELECT run_id, target FROM e
            WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.target = e.target AND s.run_id IS NOT DISTINCT FROM e.run_id)""",
        "host_check": """
            WITH t AS (
                SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '10.0.0.' || CAST(c_custkey % 300 AS VARCHAR)
                           WHEN 1 THEN printf('fe80::%x', c_custkey) WHEN 2 THEN 'host name' END AS target,
                       CASE WHEN c_custkey % 4 = 0 AND c_custkey % 300 < 256 THEN 4
                            WHEN c_custkey % 4 = 1 AND c_custkey < 65536 THEN 6 END::VARCHAR AS version
                FROM customer)
            SELECT c_custkey, target, version IS NOT NULL AS is_valid, version FROM t""",
        "stored_regions": f"""{_regions_sql(B, 3600, 200, 'segment_idx')}
            SELECT 'events' AS run_id, segment_idx, start_s, end_s,
                   start_s = min(start_s) OVER (PARTITION BY segment_idx) AS is_first,
                   start_s - 0.5::DOUBLE AS pad_start, end_s + 0.5::DOUBLE AS pad_end
            FROM g""",
        "stored_segments": f"""{B},
            k AS (SELECT max_seq, unnest(range(0, (max_seq - 1) // 3600 + 1)) AS segment_idx FROM m),
            e AS (SELECT segment_idx, segment_idx * 3600 AS start_s, least(segment_idx * 3600 + 3600, max_seq) AS end_s FROM k)
            SELECT 'events' AS run_id, segment_idx, start_s, end_s,
                   'hour_' || CAST(segment_idx + 1 AS VARCHAR) AS segment_label,
                   printf('Hour %d (%d:%02d:%02d to %d:%02d:%02d)', segment_idx + 1,
                          start_s // 3600, start_s % 3600 // 60, start_s % 60,
                          end_s // 3600, end_s % 3600 // 60, end_s % 60) AS title
            FROM e""",
        "stored_agg_series": _segment_agg_sql(B, 3600, 60),
        "stored_y_limits": _y_limit_sql(B, 60),
        "stored_silent": """
            SELECT 'events' AS run_id, CAST(c_custkey AS VARCHAR) AS target FROM customer
            WHERE c_custkey NOT IN (SELECT user_id % 3 FROM events)""",
        "ingest_ledger": f"""
            SELECT '{RUN}' AS run_id, CAST(user_id % 3 AS VARCHAR) AS target, count(*) AS lines, true AS ended
            FROM events GROUP BY user_id % 3""",
        "stored_summary": f"""
            SELECT target, total::VARCHAR AS total_pings, successful::VARCHAR AS successful_pings,
                   printf('%.2f%%', packet_loss_pct) AS packet_loss,
                   coalesce(printf('%.2f', avg_ms), 'N/A') AS average_latency,
                   coalesce(printf('%.2f', min_ms), 'N/A') AS min_latency,
                   coalesce(printf('%.2f', max_ms), 'N/A') AS max_latency
            FROM ({SUMMARY})""",
        "stored_malformed": f"""
            SELECT CAST(user_id AS VARCHAR) AS target, count(*) AS n_lines,
                   count(*) FILTER (malformed) AS n_malformed
            FROM ({LINE_KINDS}) GROUP BY user_id""",
        "sink_text_appended": f"""{A}
            SELECT 'events' AS run_id, target, seq, latency_ms, false AS malformed FROM s""",
    }
