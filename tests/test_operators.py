import dataclasses
import re
import random
import math

import model
import pytest
from pyspark.sql import functions as F

from hoplens.functions.series import display_value, fill_and_clip, fixed2, health_band, live_scale, span_text, zero_fill
from hoplens.operators import hosts, live, regions, segments, summary, windows
from hoplens.operators.extent import max_duration, measure
from hoplens.operators.numbering import with_seq
from hoplens.plans.report import analyse
from hoplens.settings import Settings

X = [10, 250, None, 40, 900, 60, 210, 220]
Y = [5, 5, 5, 201, 5]
XY = {"r": {"X": X, "Y": Y}}
LOST = {"r": {"gone": [None] * 4}}
MANY = [model.random_data(seed) for seed in range(4)] + [
    XY,
    LOST,
    {"r": {"one": [5.0]}},
    {"r": {"one": [5.0], "two": [300.0, 400.0]}, "q": {"one": [None, model.NAN, 3.0]}},
]
# Many runs in one table, and a single run, which takes plans without a join.
DATA = [
    {f"{n}-{run}": by_target for n, data in enumerate(MANY) for run, by_target in data.items()},
    model.random_data(21, runs=1, targets=6),
]


def keyed(frame, *keys):
    rows = frame.collect()
    out = {tuple(row[key] for key in keys): row for row in rows}
    assert len(out) == len(rows)
    return out


def close(a, b):
    if a is None or b is None:
        return a is b
    return (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-9)


@pytest.mark.parametrize("data", DATA)
@pytest.mark.parametrize("interval, repair", [(3, True), (10, False), (60, True)])
def test_windows(spark, data, interval, repair):
    got = keyed(windows.window_agg(model.frame(spark, data), interval, repair), "run_id", "target", "window_idx")
    want = model.windows(data, interval, repair)
    assert got.keys() == want.keys()
    for key, row in got.items():
        for a, b in zip((row.mid_s, row.n, row.lost, row.mean_latency_ms, row.packet_loss_pct), want[key]):
            assert close(a, b), (key, row, want[key])


def test_window_fixtures(spark):
    def run(series):
        got = windows.window_agg(model.frame(spark, {"r": {"h": series}}), 3).orderBy("window_idx").collect()
        return [(row.mid_s, round(row.mean_latency_ms, 9), round(row.packet_loss_pct, 3)) for row in got]

    assert run([23.5, 24.1, None, 25.0, 26.2, None]) == [(1.5, 23.8, 33.333), (4.5, 25.6, 33.333)]
    assert run([10, None, 30, None, None, None, 250]) == [(1.5, 20.0, 33.333), (4.5, 0.0, 100.0), (6.5, 250.0, 0.0)]


def test_all_lost_windows_and_head(spark):
    data = model.random_data(11, lost=0.6, nan=0)
    samples = model.frame(spark, data)
    got = keyed(windows.all_lost_windows(windows.window_agg(samples, 3)), "run_id", "target", "window_idx")
    assert got.keys() == {key for key, (_, n, gone, *_) in model.windows(data, 3).items() if n == gone}
    head = keyed(windows.window_head(samples, 7, 3), "run_id", "target", "window_idx")
    assert head.keys() == {key for key in model.windows(data, 7) if key[2] < 3}


@pytest.mark.parametrize("duration, off, count", [(59, False, 0), (60, False, 1), (60, True, 0), (10800, False, 1)])
def test_aggregation_gate(spark, duration, off, count):
    settings = Settings(duration=duration, no_aggregation=off)
    gated = windows.gated_window_agg(model.frame(spark, {"r": {"h": [1.0]}}), settings.aggregate)
    assert gated.count() == count
    assert gated.columns == windows.window_agg(model.frame(spark, XY)).columns


@pytest.mark.parametrize("values", [{"duration": 0}, {"duration": 1.5}, {"ping_interval": -1}, {"latency_threshold": 0}, {"latency_threshold": "x"}])
def test_settings_are_checked(values):
    with pytest.raises(ValueError):
        Settings(**values)


def test_setting_defaults():
    default = Settings()
    assert (default.duration, default.ping_interval, default.latency_threshold) == (10800, 1, 200.0)
    assert default.aggregate and default.segment_len == 3600 and Settings(no_segmentation=True).segment_len is None


@pytest.mark.parametrize("data", DATA)
def test_summary(spark, data):
    got = keyed(summary.target_summary(model.frame(spark, data)), "run_id", "target")
    want = model.summary(data)
    assert got.keys() == want.keys()
    for key, row in got.items():
        for a, b in zip(list(row)[2:], want[key]):
            assert close(a, b), (key, row, want[key])


def test_summary_text(spark):
    text = keyed(summary.summary_display(summary.target_summary(model.frame(spark, {"r": {"X": X, "gone": [None] * 4}}))), "target")
    assert list(text["X",])[2:] == ["8", "7", "12.50%", "241.43", "10.00", "900.00"]
    assert list(text["gone",])[2:] == ["4", "0", "100.00%", "N/A", "N/A", "N/A"]


def test_two_decimals_as_python(spark):
    numbers = [0.0, 0.005, 0.015, 0.125, 0.375, 2.675, 1.005, 1e-9, 123456789.125, 99.995, -2.5, 1e15, math.inf, -math.inf]
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(numbers)], "n int, x double")
    got = [row[0] for row in rows.orderBy("n").select(fixed2(F.col("x"))).collect()]
    assert got == [f"{x:.2f}" for x in numbers]


def test_columns(spark):
    rows = spark.createDataFrame([(n, x) for n, x in enumerate([10.0, None, model.NAN, 900.0, 74.9, 75.0, 124.9, 125.0])], "n int, x double")
    x = F.col("x")
    got = rows.orderBy("n").select(fill_and_clip(x), zero_fill(x), display_value(x), health_band(x), live_scale(x)).collect()
    assert [row[0] for row in got] == [10, 800, 800, 800, 74.9, 75, 124.9, 125]
    assert [row[1] for row in got] == [10, 0, 0, 900, 74.9, 75, 124.9, 125]
    assert [row[2] for row in got] == ["10.0 ms", "Lost", "Lost", "800.0 ms", "74.9 ms", "75.0 ms", "124.9 ms", "125.0 ms"]
    assert [row[3] for row in got[3:]] == ["red", "green", "yellow", "yellow", "red"]
    assert [row[4] for row in got][:2] == [100, 100] and got[3][4] == 900


@pytest.mark.parametrize("seconds, text", [(0, "0:00:00"), (3599, "0:59:59"), (86400, "1 day, 0:00:00"), (190000, "2 days, 4:46:40")])
def test_span_text(spark, seconds, text):
    assert spark.range(1).select(span_text(F.lit(seconds).cast("long"))).first()[0] == text


@pytest.mark.parametrize("data", DATA)
def test_extent(spark, data):
    samples = model.frame(spark, data)
    want = model.longest(data)
    lengths = [len(series) for _, _, series in model.each(data)]
    assert {row.run_id: row.max_seq for row in max_duration(samples).collect()} == want
    for max_runs in (100, 0):
        extent = measure(samples, max_runs)
        assert (extent.runs, extent.series, extent.rows) == (len(want), len(lengths), sum(lengths))
        assert (extent.longest, extent.times) == (max(lengths), sum(want.values()))
        assert {row.run_id: row.max_seq for row in extent.by_run.collect()} == want
        again = segments.segment_raw(samples, 20, extent)
        assert again.count() == len(model.raw(data, 20))


@pytest.mark.parametrize("data", DATA)
@pytest.mark.parametrize("segment_len, interval", [(20, 10), (7, 3), (1, 2), (5, 13), (3600, 60), (None, 10)])
def test_segments(spark, data, segment_len, interval):
    samples, extent = model.frame(spark, data), None
    extent = measure(samples)
    table = keyed(segments.segment_table(extent, segment_len), "run_id", "segment_idx")
    want = {(run, k): span for run in data for k, span in enumerate(model.spans(data, run, segment_len))}
    assert {key: (row.start_s, row.end_s) for key, row in table.items()} == want
    raw = keyed(segments.segment_raw(samples, segment_len, extent), "run_id", "target", "segment_idx", "seq")
    assert {key: row.ping_ms for key, row in raw.items()} == model.raw(data, segment_len)
    agg = segments.segment_agg(windows.window_agg(samples, interval), extent, segment_len)
    assert keyed(agg, "run_id", "target", "segment_idx", "window_idx").keys() == model.agg(data, segment_len, interval)
    if segment_len is not None:
        empty = segments.empty_segments(samples, segment_len, interval, extent=extent)
        assert keyed(empty, "run_id", "target", "segment_idx", "series").keys() == model.empty(data, segment_len, interval)
        only_raw = segments.empty_segments(samples, segment_len, interval, aggregate=False)
        assert only_raw.count() == sum(key[3] == "raw" for key in model.empty(data, segment_len, interval))


def test_long_ranges_are_exploded_in_steps(spark):
    rows = spark.createDataFrame([("a", 24_999), ("b", 0), ("c", 9_999), ("d", 10_000)], "k string, last bigint")
    got = segments.explode_range(rows, F.col("last"), "i")
    counts = {row.k: (row.n, row.top) for row in got.groupBy("k").agg(F.count_distinct("i").alias("n"), F.max("i").alias("top")).collect()}
    assert counts == {"a": (25_000, 24_999), "b": (1, 0), "c": (10_000, 9_999), "d": (10_001, 10_000)}
    assert got.count() == 25_000 + 1 + 10_000 + 10_001


def test_segment_titles(spark):
    data = {"r": {"h": [1.0] * 50}}
    titles = segments.segment_titles(segments.segment_table(measure(model.frame(spark, data)), 30)).orderBy("segment_idx")
    assert [row.title for row in titles.collect()] == ["Hour 1 (0:00:00 to 0:00:30)", "Hour 2 (0:00:30 to 0:00:50)"]
    whole = segments.segment_titles(segments.segment_table(measure(model.frame(spark, data)), None)).first()
    assert (whole.segment_label, whole.title, whole.start_s, whole.end_s) == ("entire_duration", "Entire Duration", 0, 50)


@pytest.mark.parametrize("data", DATA)
@pytest.mark.parametrize("segment_len, block", [(20, 1_000_000), (20, 6), (3600, 1_000_000), (None, 1_000_000), (None, 7)])
def test_regions(spark, data, segment_len, block):
    samples = model.frame(spark, data)
    extent = measure(samples)
    high = regions.high_latency(samples, 90.0, segment_len, extent)
    assert high.count() == sum(value > 90 for value in model.raw(data, segment_len).values())
    found = regions.regions(high, segment_len, block=block)
    want = model.high_regions(data, segment_len, 90)
    assert {tuple(row) for row in found.collect()} == want and found.count() == len(want)
    single = regions.regions(high, segment_len, by_target=True, block=block)
    assert {tuple(row) for row in single.collect()} == model.high_regions(data, segment_len, 90, by_target=True)
    padded = regions.pad_regions(found, segment_len, extent, block).collect()
    assert {(row.pad_start + 0.5, row.pad_end - 0.5) for row in padded} == {region[-2:] for region in want}
    firsts = {(run, k): min(r[2] for r in want if r[:2] == (run, k)) for run, k, *_ in want}
    assert {tuple(row)[:3] for row in padded if row.is_first} == {(*key, start) for key, start in firsts.items()}
    for limit in (0, 1_000_000):
        members = regions.samples_in_regions(samples, 90.0, segment_len, extent, block, limit)
        inside = {
            (run, target, k, seq, start, end)
            for run, target, k, seq in model.raw(data, segment_len)
            for r, s, start, end in want
            if (r, s) == (run, k) and start - 0.5 <= seq <= end + 0.5
        }
        got = [(row.run_id, row.target, row.segment_idx, row.seq, row.start_s, row.end_s) for row in members.collect()]
        assert set(got) == inside and len(got) == len(inside)


def test_region_fixtures(spark):
    samples = model.frame(spark, XY)

    def run(segment_len, threshold=200.0):
        found = regions.regions(regions.high_latency(samples, threshold, segment_len), segment_len)
        return sorted((row.segment_idx, row.start_s, row.end_s) for row in found.collect())

    assert run(3600) == [(0, 2, 5), (0, 7, 7)]
    assert run(4) == [(0, 2, 3), (1, 4, 5), (1, 7, 7)]
    assert run(None) == [(0, 2, 5), (0, 7, 7)]
    assert run(3600, 800.0) == []
    times = regions.high_times_sorted(regions.high_latency(samples, 200.0))
    assert [row.seq for row in times.collect()] == [2, 3, 4, 5, 7]
    bag = regions.union_high_times(*[regions.high_latency(samples.where(f"target = '{t}'"), 200.0) for t in "XY"])
    assert sorted(row.seq for row in bag.collect()) == [2, 3, 4, 5, 7]


@pytest.mark.parametrize("data", DATA)
@pytest.mark.parametrize("size, chunk", [(30, 1_000_000), (30, 40), (5, 7), (6, 2), (1, 3)])
def test_rolling_max(spark, data, size, chunk):
    got = keyed(live.rolling_max(model.frame(spark, data), size, chunk), "run_id", "target", "seq")
    assert {key: row.window_max for key, row in got.items()} == model.rolling(data, size)


@pytest.mark.parametrize("data", DATA)
def test_live_end_state(spark, data):
    samples = model.frame(spark, data)
    buffers = keyed(live.rolling_buffer(samples, 30), "run_id", "target")
    assert {key: row.buffer for key, row in buffers.items()} == model.buffer(data, 30)
    status = keyed(live.live_status(samples, 30), "run_id", "target")
    for run, target, series in model.each(data):
        row, top = status[run, target], max(model.buffer(data, 30)[run, target])
        assert row.latest == ("Lost" if model.missing(series[-1]) else f"{min(series[-1], 800.0)!r} ms" if isinstance(series[-1], float) else f"{min(float(series[-1]), 800.0)} ms")
        assert (row.seq, row.window_max, row.scale_max) == (len(series), top, max(top, 100.0))
        assert row.band == ("green" if top < 75 else "yellow" if top < 125 else "red")
    tail = keyed(live.tail_n(samples, 5), "run_id", "target", "seq")
    assert tail.keys() == {(run, t, n) for run, t, s in model.each(data) for n in range(max(1, len(s) - 4), len(s) + 1)}


def test_negative_values_stay_below_the_zero_seed(spark):
    data = {"r": {"h": [-5.0] * 31}}
    got = keyed(live.rolling_max(model.frame(spark, data), 30), "seq")
    assert got[29,].window_max == 0.0 and got[30,].window_max == -5.0
    assert live.live_status(model.frame(spark, data), 30).first().window_max == -5.0
    assert live.live_status(model.frame(spark, {"r": {"h": [-5.0] * 3}}), 30).first().window_max == 0.0


@pytest.mark.parametrize(
    "series, aggregate, want",
    [([10.0, 20.0], True, 21.0), ([900.0], True, 800.0), ([None, None], True, None), ([800.0], True, 840.0),
     ([-5.0, None, None, None, None], True, 0.0), ([-5.0, None, None, None, None], False, -5.25), ([model.NAN, 4.0], True, 4.2)],
)
def test_y_limit(spark, series, aggregate, want):
    got = windows.y_limit(model.frame(spark, {"r": {"h": series}}), 2, aggregate).first().y_max
    assert got is None if want is None else math.isclose(got, want)


def test_silent_targets(spark):
    expected = spark.createDataFrame([("X",), ("Z",)], "target string")
    assert [row.target for row in hosts.silent_targets(expected, model.frame(spark, XY)).collect()] == ["Z"]


def test_malformed_audit(spark):
    rows = [("r", "a", True), ("r", "a", False), ("r", "b", False)]
    got = keyed(summary.malformed_audit(spark.createDataFrame(rows, "run_id string, target string, malformed boolean")), "target")
    assert {key[0]: (row.n_lines, row.n_malformed) for key, row in got.items()} == {"a": (2, 1), "b": (1, 0)}


def test_report(spark):
    report = analyse(model.frame(spark, XY))
    assert {tuple(row)[2:4] for row in report.regions.collect()} == {(2, 5), (7, 7)}
    assert report.raw_series.count() == 7 + 5 and report.agg_series.count() == 2
    assert {row.target: row.y_max for row in report.y_limits.collect()} == {"X": 800.0, "Y": 201 * 1.05}
    assert report.segments.count() == 1 and report.summary_text.count() == 2
    off = analyse(model.frame(spark, XY), Settings(duration=30, no_segmentation=True))
    assert off.agg_series.count() == 0 and off.segments.first().segment_label == "entire_duration"


@pytest.mark.parametrize("runs", [("r",), (None,), ("r", None), ("r", None, "", "q")])
def test_null_keys_are_keys(spark, runs):
    """A run or target that is NULL or empty gives the rows of any other, alone or beside others."""
    rows = [(run, target, seq, float(seq)) for run in runs for target in (None, "", "a") for seq in range(1, 6)]
    samples = spark.createDataFrame(rows, "run_id string, target string, seq bigint, latency_ms double")
    assert segments.segment_raw(samples, 2).count() == 12 * len(runs)
    high = regions.high_latency(samples, 0.5, None)
    assert [(row.start_s, row.end_s) for row in regions.regions(high, None, by_target=True).collect()] == [(1, 4)] * 3 * len(runs)
    assert regions.samples_in_regions(samples, 0.5, None, max_broadcast_times=0).count() == 12 * len(runs)
    many = measure(samples, max_runs=0)
    assert segments.segment_raw(samples, 2, many).count() == 12 * len(runs)
    numbered = with_seq(samples.drop("seq"), ["latency_ms"], rows_per_task=2)
    assert numbered.where("seq = latency_ms").count() == len(rows)


def test_silent_targets_of_a_run(spark):
    rows = [("r1", "a", 1, 1.0), ("r1", "b", 1, 1.0), ("r2", "a", 1, 1.0), (None, "b", 1, 1.0)]
    samples = spark.createDataFrame(rows, "run_id string, target string, seq bigint, latency_ms double")
    found = hosts.silent_in_runs(spark.createDataFrame([("a",), ("b",)], "target string"), samples)
    assert {tuple(row) for row in found.select("run_id", "target").collect()} == {("r2", "b"), (None, "a")}


def test_one_range_for_a_short_series(spark):
    """Many short series beside a long one: a range for each, not a row for each of the long one's segments."""
    rows = [("r", f"h{n}", 1, 1.0) for n in range(50)] + [("r", "long", seq, 1.0) for seq in range(1, 2001)]
    samples = spark.createDataFrame(rows, "run_id string, target string, seq bigint, latency_ms double")
    found = segments.empty_segment_ranges(samples, 2, aggregate=False)
    assert found.count() == 50
    assert segments.empty_segments(samples, 2, aggregate=False).count() == 50 * 999


def test_small_values_are_written_out(spark):
    rows = spark.createDataFrame([(0.0005,), (1e-5,), (12.5,), (900.0,), (None,), (0.0,)], "v double")
    assert [row.text for row in rows.select(display_value(F.col("v")).alias("text")).collect()] == [
        "0.0005 ms", "0.00001 ms", "12.5 ms", "800.0 ms", "Lost", "0.0 ms",
    ]


@pytest.mark.parametrize("block, series", [(1, 1), (4, 2), (10, 10_000), (4096, 1)])
def test_samples_in_given_regions(spark, monkeypatch, block, series):
    """Regions of other samples: overlapping, of one position, beyond all samples, and of a NULL run."""
    monkeypatch.setattr(regions, "JOIN_SERIES", series)
    data = model.random_data(31, runs=2, targets=5, longest=60)
    data[None] = data.pop("run1")
    rows = model.to_rows(data)
    spans = [("run0", 3, 3), ("run0", 2, 40), ("run0", 38, 41), (None, 1, 500), ("run0", 100, 9000), ("absent", 1, 9), ("run0", 9, 8)]
    found = spark.createDataFrame([(*span, n) for n, span in enumerate(spans)], "run_id string, start_s bigint, end_s bigint, number int")
    got = regions.samples_in(model.frame(spark, data), found, block=block)
    assert got.columns == ["run_id", "target", "seq", "latency_ms", "start_s", "end_s", "number"]
    keys = sorted((str(row.run_id), row.target, row.seq, row.number) for row in got.collect())
    assert keys == sorted(
        (str(run), target, seq, number) for run, target, seq, _ in rows for number, (of, start, end) in enumerate(spans)
        if of == run and start <= seq <= end
    )
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_samples_in_regions_of_single_targets(spark):
    data = model.random_data(32, runs=2, targets=4, longest=50)
    samples = model.frame(spark, data)
    found = regions.regions(regions.high_latency(samples, 100.0, 20), 20, by_target=True)
    got = regions.samples_in(samples, found, block=7)
    inside = {(run, target, seq) for run, target, start, end in found.select("run_id", "target", "start_s", "end_s").collect() for seq in range(start, end + 1)}
    assert {(row.run_id, row.target, row.seq) for row in got.collect()} == inside and got.count() == len(inside)


def test_silent_targets_of_every_run(spark, monkeypatch):
    """Several bitmaps, full and empty ones, and NULL as a run and as a target."""
    rng = random.Random(5)
    expected = [None, ""] + [f"t{n}" for n in range(70_000)]
    heard = [("full", target) for target in expected] + [("few", "t5"), ("other", "unexpected"), (None, None), (None, "t69999")]
    heard += [("some", target) for target in expected if rng.random() < 0.999]
    samples = spark.createDataFrame(heard * 2, "run_id string, target string")
    listed = spark.createDataFrame([(target,) for target in expected + expected[:10]], "target string")
    got = {}
    for row in hosts.silent_in_runs(listed, samples).collect():
        got.setdefault(row.run_id, []).append(row.target)
    of = lambda run: {target for run_id, target in heard if run_id == run}
    wanted = {run: set(expected) - of(run) for run in ("few", "other", None, "some")}
    assert {run: set(targets) for run, targets in got.items()} == wanted
    assert all(len(targets) == len(set(targets)) for targets in got.values())
    assert hosts.silent_in_runs(listed.limit(0), samples).count() == 0


@pytest.mark.parametrize("size", [1, 2, 29, 30, 100, 1000])
def test_rolling_maximum_of_any_size(spark, size):
    data = model.random_data(40, runs=1, targets=3, longest=400)
    got = keyed(live.rolling_max(model.frame(spark, data), size, 64), "run_id", "target", "seq")
    assert {key: row.window_max for key, row in got.items()} == model.rolling(data, size)


def test_rolling_maximum_makes_no_sequence(spark):
    plan = live.rolling_max(model.frame(spark, model.random_data(1)), 3000)._jdf.queryExecution().executedPlan().toString()
    assert "sequence(" not in plan and "-2999, currentrow" not in plan


def test_repeated_regions_are_not_broadcast(spark):
    """Regions are repeated for groups of series, so the size of their files says nothing; blocks without samples get none."""
    data = {"run0": {f"h{n}": [float(n % 7 * 50 + i) for i in range(20)] for n in range(40)}}
    samples = model.frame(spark, data)
    found = spark.createDataFrame([("run0", 2, 5), ("run0", 11, 900), ("run0", 5000, 5001)], "run_id string, start_s bigint, end_s bigint")
    extent = dataclasses.replace(measure(samples), series=5000)
    got = regions.samples_in(samples, found, extent, block=7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin [^\n]*_salt", plan) and "LeftSemi" in plan
    assert sorted(row.seq for row in got.where("target = 'h3'").collect()) == [2, 3, 4, 5, *range(11, 21)] and got.count() == 40 * 14
