import datetime as dt
import random
import time
from datetime import datetime

import model
import pytest

from hoplens.operators.live import live_status
from hoplens.operators.summary import target_summary
from hoplens.schema import SAMPLES
from hoplens.sources import updates
from hoplens.sources.appended import appended_stream
from hoplens.sources.tables import read_samples
from hoplens.sources.text import scan_runs
from hoplens.streaming import operators, streams

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def land(spark, data, folder, files, shuffle=False):
    """Samples in several landing files, in time order or not."""
    rows = sorted(model.to_rows(data), key=lambda row: row[2])
    if shuffle:
        random.Random(2).shuffle(rows)
    size = -(-len(rows) // files)
    for n in range(files):
        part = [(*row[:3], START + dt.timedelta(minutes=row[2]), row[3], False) for row in rows[n * size : (n + 1) * size]]
        frame = spark.createDataFrame(part, "run_id string, target string, seq bigint, ts timestamp, latency_ms double, malformed boolean")
        frame.coalesce(1).write.mode("append").parquet(str(folder))


def finish(spark, stream, path, **options):
    query = streams.store(stream, str(path), every=None, **options)
    streams.run_to_end(query)
    return spark.read.schema(stream.schema).parquet(str(path)), query


@pytest.mark.parametrize("shuffle", [False, True])
def test_live_updates(spark, tmp_path, shuffle):
    """The end state is that of the whole data, however rows fall into batches."""
    data = model.random_data(6, runs=1, targets=3, longest=120)
    data["run0"]["short"] = [None, 5.0]
    land(spark, data, tmp_path / "in", 4, shuffle)
    stream = operators.live_updates(streams.sample_stream(spark, str(tmp_path / "in"), max_files=1), "seq")
    updates, query = finish(spark, stream, tmp_path / "out")
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4
    last = streams.newest(updates, ["run_id", "target"], "seq")
    want = live_status(model.frame(spark, data))
    assert {tuple(row) for row in last.collect()} == {tuple(row) for row in want.select(last.columns).collect()}


def test_summary_updates(spark, tmp_path):
    data = model.random_data(8, runs=2, targets=3)
    data["run0"]["gone"] = [None] * 5
    land(spark, data, tmp_path / "in", 3)
    stream = operators.summary_updates(streams.sample_stream(spark, str(tmp_path / "in"), max_files=1))
    streams.run_to_end(streams.store_updates(stream, str(tmp_path / "out"), str(tmp_path / "state"), every=None))
    updates = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("batch=*"))) >= 3
    last = streams.newest(updates, ["run_id", "target"], "total").collect()
    want = model.summary(data)
    assert {(row.run_id, row.target) for row in last} == want.keys()
    for row in last:
        for a, b in zip(list(row)[2:], want[row.run_id, row.target]):
            assert (a is None and b is None) or abs(a - b) < 1e-9


def test_samples_without_clock_and_key(spark, tmp_path):
    """Text samples have no time and a key may be missing: positions order them, over several batches."""
    for first in (1, 41, 81):
        rows = [("r", target, seq, None, float(seq), False) for target in (None, "a") for seq in range(first, first + 40)]
        frame = spark.createDataFrame(rows, SAMPLES)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = streams.sample_stream(spark, str(tmp_path / "in"), max_files=1)
    updates, _ = finish(spark, operators.live_updates(source, "seq"), tmp_path / "live")
    last = {row.target: row for row in streams.newest(updates, ["run_id", "target"], "seq").collect()}
    assert {target: (row.seq, row.window_max) for target, row in last.items()} == {None: (120, 120.0), "a": (120, 120.0)}
    summary = operators.summary_updates(source)
    streams.run_to_end(streams.store_updates(summary, str(tmp_path / "sum"), every=None))
    stored = spark.read.schema(summary.schema).parquet(str(tmp_path / "sum"))
    assert {row.target: row.total for row in streams.newest(stored, ["run_id", "target"], "total").collect()} == {None: 120, "a": 120}


def test_idle_state_is_freed(spark, tmp_path):
    land(spark, {"r": {"a": [1.0] * 5, "b": [2.0] * 3}}, tmp_path / "in", 1)
    stream = operators.live_updates(streams.sample_stream(spark, str(tmp_path / "in")), "seq", idle_ms=1)
    query = streams.store(stream, str(tmp_path / "out"), every="100 milliseconds")
    try:
        for _ in range(300):
            time.sleep(0.2)
            last = query.lastProgress
            if last and last["batchId"] > 0 and last["stateOperators"][0]["numRowsTotal"] == 0:
                break
    finally:
        query.stop()
    assert last["stateOperators"][0]["numRowsTotal"] == 0
    stored = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    assert {row.target: row.seq for row in stored.collect()} == {"a": 5, "b": 3}


def test_summary_of_a_stream_with_updates(spark, tmp_path):
    data = model.random_data(8, runs=1, targets=2)
    land(spark, data, tmp_path / "in", 2)
    stream = target_summary(streams.sample_stream(spark, str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(row.run_id, row.target): row.total for row in spark.table("totals").collect()} == {
        key: value[0] for key, value in model.summary(data).items()
    }


def test_time_windows_drop_late_rows(spark, tmp_path):
    rows = [[(0, 10.0), (5, None), (14, 30.0)], [(40, 1.0)], [(41, 2.0)], [(3, 99.0)], [(90, 5.0)]]
    for batch in rows:
        part = [("r", "h", 0, START + dt.timedelta(minutes=minute), latency, False) for minute, latency in batch]
        frame = spark.createDataFrame(part, "run_id string, target string, seq bigint, ts timestamp, latency_ms double, malformed boolean")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = operators.time_windows(streams.sample_stream(spark, str(tmp_path / "in"), max_files=1), "10 minutes", "10 minutes")
    closed, _ = finish(spark, stream, tmp_path / "out")
    got = {((row.window_start.minute), row.n, row.lost, row.mean_latency_ms, row.packet_loss_pct) for row in closed.collect()}
    assert got == {(0, 2, 1, 10.0, 50.0), (10, 1, 0, 30.0, 0.0), (40, 2, 0, 1.5, 0.0)}


def test_restart_continues(spark, tmp_path):
    data = model.random_data(12, runs=1, targets=2, nan=0)
    land(spark, data, tmp_path / "in", 1)
    for length in (1, 2):
        if length == 2:
            land(spark, {"later": {"h": [1.0, 2.0]}}, tmp_path / "in", 1)
        stream = streams.sample_stream(spark, str(tmp_path / "in"))
        query = streams.store_samples(stream, str(tmp_path / "out"), every=None, checkpoint=str(tmp_path / "state"))
        streams.run_to_end(query)
        assert spark.read.parquet(str(tmp_path / "out")).count() == len(model.to_rows(data)) + (2 if length == 2 else 0)


def test_paced_query(spark, tmp_path):
    land(spark, {"r": {"h": [1.0, 2.0]}}, tmp_path / "in", 1)
    query = streams.store(streams.sample_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), every="100 milliseconds")
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_result_stream(spark, tmp_path):
    folder = tmp_path / "results_2024-01-01_00-00-00"
    folder.mkdir()
    (folder / "ping_results_a b.txt").write_text("1.5\nLost\nbad\n")
    (folder / "other.txt").write_text("9\n")
    rows, _ = finish(spark, streams.result_stream(spark, f"{tmp_path}/results_*"), tmp_path / "out")
    got = sorted((row.run_id, row.target, row.latency_ms or 0, row.malformed) for row in rows.collect())
    run = "2024-01-01_00-00-00"
    assert got == [(run, "a b", 0, False), (run, "a b", 0, True), (run, "a b", 1.5, False)]


def appended(spark, tmp_path, texts, **options):
    """A query over appended lines that is run after each step of writing."""
    folder = tmp_path / "results_2023-10-05_12-00-00"
    folder.mkdir(exist_ok=True)
    for step in texts:
        for name, text in step.items():
            with (folder / f"ping_results_{name}.txt").open("ab") as file:
                file.write(text)
        lines = appended_stream(spark, f"{tmp_path}/results_*", f"{tmp_path}/sizes")
        streams.run_to_end(streams.store_appended(lines, f"{tmp_path}/table", f"{tmp_path}/checkpoint", every=None, **options))
    return folder


def stored(samples):
    return sorted(tuple(row) for row in samples.select("run_id", "target", "seq", "latency_ms", "malformed").collect())


def test_appended_lines_equal_one_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("hoplens.sources.appended.RANGE_BYTES", 7)
    steps = [
        {"a": b"1\n2\nLo", "b x%": b"5\r\n"}, {"a": b"st\n"}, {}, {"a": b"bad\n\n7", "new": b""}, {"a": b"7\n", "new": b"9\n" * 40, "b x%": b"6\r\n"},
    ]
    appended(spark, tmp_path, steps, merge_every=2)
    (tmp_path / "results_2023-10-05_12-00-00" / "other.txt").write_text("1\n")
    table = read_samples(spark, str(tmp_path / "table"))
    assert stored(table) == stored(scan_runs(spark, f"{tmp_path}/results_*"))
    assert len(list((tmp_path / "sizes").glob("*.json"))) <= 3


def test_an_open_line_waits_for_its_end(spark, tmp_path):
    appended(spark, tmp_path, [{"a": b"1\n2"}])
    assert [row.latency_ms for row in read_samples(spark, str(tmp_path / "table")).collect()] == [1.0]
    appended(spark, tmp_path, [{"a": b"3\n"}])
    assert [row.latency_ms for row in read_samples(spark, str(tmp_path / "table")).orderBy("seq").collect()] == [1.0, 23.0]


def test_a_batch_that_is_run_again_replaces_its_own(spark, tmp_path, monkeypatch):
    """The first try stores its samples and fails before the log has them."""
    real = streams.updates.put
    appended(spark, tmp_path, [{"a": b"1\n"}])
    with monkeypatch.context() as broken:
        broken.setattr(streams.updates, "put", lambda *rest: 1 / 0)
        with pytest.raises(Exception):
            appended(spark, tmp_path, [{"a": b"2\n"}])
    assert streams.updates.put is real
    # The first run after a failure ends the batch that failed, the next one takes what came later.
    appended(spark, tmp_path, [{"a": b"3\n"}, {}])
    assert [(row.seq, row.latency_ms) for row in read_samples(spark, str(tmp_path / "table")).orderBy("seq").collect()] == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_closed_runs_free_their_state(spark, tmp_path):
    """Each batch has a series of its own, hours after the one before; a closed one is given out once and its state goes."""
    schema = "run_id string, target string, ts timestamp, latency_ms double"
    for number in range(5):
        rows = [("r", f"t{number}", datetime(2024, 1, 1 + number, 0, minute), None if minute % 3 else float(minute)) for minute in range(10)]
        rows.append(("r", None, datetime(2024, 1, 1 + number), float("nan")))
        rows.append(("r", "untimed", None, 1.0))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streams.store(operators.closed_runs(stream, "1 hour", "1 minute"), str(tmp_path / "out"), every=None)
    streams.run_to_end(query)
    kept = [progress["stateOperators"][0]["numRowsTotal"] for progress in query.recentProgress if progress["stateOperators"]]
    assert kept[-1] <= 2 and max(kept) <= 4
    closed = {(row.target, str(row.from_ts)): row for row in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(closed) == 8 and "untimed" not in {target for target, _ in closed}
    one = closed["t2", "2024-01-03 00:00:00"]
    assert (one.total, one.successful, one.avg_ms, one.min_ms, one.max_ms) == (10, 4, 4.5, 0.0, 9.0)
    assert str(one.to_ts) == "2024-01-03 00:09:00" and closed[None, "2024-01-02 00:00:00"].successful == 0


def test_a_merged_log_opens_few_folders(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "key string, n bigint, total bigint"
    for number in range(23):
        if number and number % 4 == 0:
            updates.merge(spark, path, schema, ["key"], "total", upto=number - 1)
        rows = [(None if number % 5 == 0 else f"k{number % 5}", number, number + 1)]
        updates.put(spark.createDataFrame(rows, schema), path, number)
        assert len(updates.state_folders(spark, path)) <= 5
    assert len(list((tmp_path / "log").iterdir())) <= 2 + 2 * 4 + 1
    newest = {row.key: row.n for row in updates.read_newest(spark, path, schema, ["key"], "total").collect()}
    assert newest == {None: 20, "k1": 21, "k2": 22, "k3": 18, "k4": 19}


def test_a_merge_that_was_broken_off_changes_nothing(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "key string, total bigint"
    for number in range(3):
        updates.put(spark.createDataFrame([("a", number)], schema), path, number)
    (tmp_path / "log" / "generation=1").mkdir()
    (tmp_path / "log" / "batch=3").mkdir()
    assert [row.total for row in updates.read_newest(spark, path, schema, ["key"], "total").collect()] == [2]
    assert updates.last_batch(spark, path) == 2
    updates.merge(spark, path, schema, ["key"], "total")
    assert updates.state_folders(spark, path) == [f"{path}/generation=2"]
    assert updates.read_newest(spark, str(tmp_path / "none"), schema, ["key"], "total").count() == 0
