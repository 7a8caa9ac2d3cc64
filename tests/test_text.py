import io
import re

import model
import pytest
from pyspark.sql import functions as F

from hoplens.functions.parsing import elapsed, parse_lines, probe_clock, run_clock
from hoplens.operators.extent import measure
from hoplens.operators.hosts import silent_targets
from hoplens.operators.partials import partials
from hoplens.plans.ingest import read_partials
from hoplens.plans.report import analyse, write_report
from hoplens import Settings, analyse_file, analyse_runs, ingest_runs, read_samples
from hoplens.schema import SAMPLES, TEXT_SAMPLES
from hoplens.sources import appended
from hoplens.sources.folders import remove
from hoplens.sources.sinks import read_segments, write_log, write_text
from hoplens.sources.text import read_lines, scan_file, scan_partitioned, scan_runs


@pytest.fixture
def root(tmp_path):
    first, second = tmp_path / "results_2023-10-05_12-00-00", tmp_path / "results_2023-10-06_00-00-00"
    for folder in (first, second, first / "inner"):
        folder.mkdir(parents=True)
    (first / "ping_results_8.8.8.8.txt").write_bytes(b"23.5\n24.1\nLost\n25.0\n\nError: x")
    (first / "ping_results_crlf host+%.txt").write_bytes(b"1.0\r\nlost\r\n3.0\r\n")
    (first / "ping_results_empty.txt").write_bytes(b"")
    (first / "other.txt").write_bytes(b"9\n")
    (first / "ping_results_x.csv").write_bytes(b"9\n")
    (first / "inner" / "ping_results_deep.txt").write_bytes(b"9\n")
    (second / "ping_results_8.8.8.8.txt").write_bytes(b"\xef\xbb\xbf7.0\n8.0\n")
    return tmp_path


def series(samples):
    out = {}
    for row in samples.orderBy("run_id", "target", "seq").collect():
        out.setdefault((row.run_id, row.target), []).append(row.latency_ms)
        assert len(out[row.run_id, row.target]) == row.seq
    return out


FIRST = "2023-10-05_12-00-00"


def test_scan_runs(spark, root):
    samples = scan_runs(spark, f"{root}/results_*")
    assert series(samples) == {
        (FIRST, "8.8.8.8"): [23.5, 24.1, None, 25.0, None, None],
        (FIRST, "crlf host+%"): [1.0, None, 3.0],
        ("2023-10-06_00-00-00", "8.8.8.8"): [7.0, 8.0],
    }
    assert samples.where("malformed").count() == 2
    wanted = {field.name: field.dataType.simpleString() for field in TEXT_SAMPLES} | {"run_ts": "timestamp_ntz"}
    assert dict(samples.dtypes) == wanted
    assert series(scan_runs(spark, f"{root}/results_{FIRST}")).keys() == {(FIRST, "8.8.8.8"), (FIRST, "crlf host+%")}


def test_empty_files_are_silent_targets(spark, root):
    expected = spark.createDataFrame([("8.8.8.8",), ("empty",)], "target string")
    silent = silent_targets(expected, scan_runs(spark, f"{root}/results_*"))
    assert [row.target for row in silent.collect()] == ["empty"]


def test_scan_file(spark, root):
    assert series(scan_file(spark, f"{root}/results_{FIRST}/ping_results_8.8.8.8.txt")) == {
        (FIRST, "8.8.8.8"): [23.5, 24.1, None, 25.0, None, None]
    }
    missing = scan_file(spark, f"{root}/nothing.txt")
    assert missing.count() == 0 and missing.schema == TEXT_SAMPLES


@pytest.mark.parametrize("split", ["2000", "7b", "1k"])
def test_order_over_splits(spark, conf, tmp_path, split):
    folder = tmp_path / "results_2024-01-01_00-00-00"
    folder.mkdir()
    for target, count in (("a", 3000), ("b", 10)):
        (folder / f"ping_results_{target}.txt").write_text("".join(f"{n}\n" for n in range(1, min(count, 400 if split == "7b" else count) + 1)))
    conf("spark.sql.files.maxPartitionBytes", split)
    samples = scan_runs(spark, str(folder))
    assert samples.where("seq <> latency_ms").count() == 0
    assert samples.count() == (400 if split == "7b" else 3000) + 10
    assert scan_file(spark, str(folder / "ping_results_a.txt")).where("seq <> latency_ms").count() == 0


@pytest.mark.parametrize("target", ["a", "b", "c"])
def test_filters_do_not_disturb_the_order(spark, conf, tmp_path, target):
    """Split sizes follow from the bytes to read, so a filter that skips files in one place only would shift them."""
    folder = tmp_path / "results_2024-01-01_00-00-00"
    folder.mkdir()
    for name, count in (("a", 9000), ("b", 1100), ("c", 20)):
        (folder / f"ping_results_{name}.txt").write_text("".join(f"{n}\n" for n in range(1, count + 1)))
    conf("spark.sql.files.openCostInBytes", "100")
    samples = scan_runs(spark, str(folder))
    assert samples.count() == 10120 and samples.where("seq <> latency_ms").isEmpty()
    one = samples.where(F.col("target") == target)
    assert one.where("seq <> latency_ms").isEmpty()
    assert one.agg(F.max("seq"), F.count("*")).first() == {"a": (9000, 9000), "b": (1100, 1100), "c": (20, 20)}[target]
    write_text(samples, str(tmp_path / "text"))
    back = scan_partitioned(spark, str(tmp_path / "text")).where(F.col("target") == target)
    assert back.where("seq <> latency_ms").isEmpty() and back.count() == one.count()


def test_counting_a_scan_reads_it_once(spark, root):
    plan = scan_runs(spark, f"{root}/results_*").groupBy("run_id", "target").count()._jdf.queryExecution().executedPlan().toString()
    # Small and large files are read apart; no text is read for a line count.
    assert plan.count("FileScan") == 2 and "Join" not in plan and plan.count("ReadSchema: struct<>") == 2
    assert "file_size" in plan
    assert measure(scan_runs(spark, f"{root}/results_*")).rows == 11


def test_text_round_trip(spark, conf, tmp_path):
    data = model.random_data(9, nan=0)
    data["run0"]["::1"] = [float(n) for n in range(500)]
    data["run0"]["01"] = [1e-5, 1e16, -0.5, None]
    samples = model.frame(spark, data)
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    path = str(tmp_path / "text")
    write_text(samples, path)
    conf("spark.sql.files.maxPartitionBytes", "200")
    back = scan_partitioned(spark, path)
    keys = ["run_id", "target", "seq", "latency_ms"]
    assert back.select(keys).exceptAll(samples.select(keys)).isEmpty() and back.count() == samples.count()
    assert back.where("malformed").isEmpty()
    one = scan_partitioned(spark, path, "target = '01'")
    assert [row.latency_ms for row in one.orderBy("seq").collect()] == [1e-5, 1e16, -0.5, None]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*target[^\]]* = 01", plan)
    part = scan_file(spark, f"{path}/run_id=run0/target=%3A%3A1")
    assert part.where("latency_ms <> seq - 1").isEmpty() and part.count() == 500


def test_reports_of_any_size_share_a_path(spark, tmp_path):
    """A small and a large report, one with many segments, are read back together, all parts of them."""
    long = {"long": {"h": [float(n % 700) for n in range(30_000)], "short": [1.0]}}
    expected = spark.createDataFrame([("h",), ("absent",)], "target string")
    reports = [analyse(model.frame(spark, data), expected=expected) for data in (model.random_data(10), long)]
    for report in reports:
        write_report(report, str(tmp_path))
    for name in reports[0]._fields:
        want = getattr(reports[0], name).unionByName(getattr(reports[1], name))
        back = read_segments(spark, f"{tmp_path}/{name}", want.schema)
        assert back.select(want.columns).exceptAll(want).isEmpty() and back.count() == want.count()
    assert {row.target for row in reports[1].silent.collect()} == {"absent"}


def two_roots(tmp_path):
    """Two monitors that began a run in the same second."""
    for place, value in (("a", 1), ("b", 2)):
        folder = tmp_path / place / f"results_{FIRST}"
        folder.mkdir(parents=True)
        (folder / "ping_results_x.txt").write_text(f"{value}\n")


def test_equal_folder_names_are_refused_or_labelled(spark, tmp_path):
    two_roots(tmp_path)
    for folders in ([f"{tmp_path}/a/results_*", f"{tmp_path}/b/results_*"], [f"{tmp_path}/*/results_*"]):
        with pytest.raises(ValueError, match="label"):
            scan_runs(spark, *folders)
    assert scan_runs(spark, f"{tmp_path}/a/results_*").first().run_id == FIRST
    both = [scan_runs(spark, f"{tmp_path}/{place}/results_*", label=place) for place in "ab"]
    assert series(both[0].unionByName(both[1])) == {(f"a/{FIRST}", "x"): [1.0], (f"b/{FIRST}", "x"): [2.0]}
    assert {str(row.run_ts) for row in both[1].collect()} == {"2023-10-05 12:00:00"}


@pytest.mark.parametrize("order", ["ab", "ba"])
def test_one_name_is_one_folder_in_every_call(spark, tmp_path, order):
    two_roots(tmp_path)
    table = str(tmp_path / "table")
    ingest_runs(spark, table, f"{tmp_path}/{order[0]}/results_*")
    for _ in range(2):
        with pytest.raises(ValueError, match="label"):
            ingest_runs(spark, table, f"{tmp_path}/{order[1]}/results_*")
    with pytest.raises(ValueError, match="label"):
        ingest_runs(spark, table, f"{tmp_path}/*/results_*")
    value = {"a": 1.0, "b": 2.0}
    ingest_runs(spark, table, f"{tmp_path}/{order[1]}/results_*", label="other")
    rows = series(ingest_runs(spark, table, f"{tmp_path}/{order[0]}/results_*"))
    assert rows == {(FIRST, "x"): [value[order[0]]], (f"other/{FIRST}", "x"): [value[order[1]]]}


def test_an_ingest_reads_only_what_is_new(spark, root, tmp_path, monkeypatch):
    """Files that have not changed are not opened; grown ones from where they ended."""
    from hoplens.plans import ingest

    table, folder = str(tmp_path / "table"), root / f"results_{FIRST}"
    ingest_runs(spark, table, f"{root}/results_*")
    read, scanned = [], []
    ranges, scan = ingest.read_ranges, ingest.scan_runs
    monkeypatch.setattr(ingest, "read_ranges", lambda frame: (read.extend(tuple(row) for row in frame.collect()), ranges(frame))[1])
    monkeypatch.setattr(ingest, "scan_runs", lambda session, *folders, **label: (scanned.extend(folders), scan(session, *folders, **label))[1])
    ingest_runs(spark, table, f"{root}/results_*")
    assert not read and not scanned
    grown = folder / "ping_results_grown.txt"
    grown.write_text("1\n2\n")
    assert series(ingest_runs(spark, table, f"{root}/results_*")) == series(scan_runs(spark, f"{root}/results_*"))
    with grown.open("a") as file:
        file.write("3\nLost\n")
    assert series(ingest_runs(spark, table, f"{root}/results_*")) == series(scan_runs(spark, f"{root}/results_*"))
    assert [(start, stop) for _, start, stop in read] == [(0, 4), (4, 11)] and not scanned


@pytest.mark.parametrize("most", [0, 100_000])
def test_lines_of_grown_files_are_not_broadcast(spark, root, tmp_path, monkeypatch, most):
    from hoplens.plans import ingest

    table, joined = str(tmp_path / "table"), []
    grown = root / f"results_{FIRST}" / "ping_results_grown.txt"
    grown.write_text("1\n2\n")
    ingest_runs(spark, table, f"{root}/results_*")
    with grown.open("a") as file:
        file.write("3\nLost\n" * 1000)
    number = ingest.with_seq
    monkeypatch.setattr(ingest, "MAX_BROADCAST_FILES", most, raising=False)
    monkeypatch.setattr(ingest, "with_seq", lambda lines, order: (joined.append(lines), number(lines, order))[1])
    assert series(ingest_runs(spark, table, f"{root}/results_*")) == series(scan_runs(spark, f"{root}/results_*"))
    [lines] = joined
    lines.collect()
    plan = lines._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert re.search("BroadcastHashJoin .* BuildRight" if most else "SortMergeJoin", joins[0]), plan


def test_rewritten_and_half_written_files(spark, root, tmp_path):
    table, folder = str(tmp_path / "table"), root / f"results_{FIRST}"
    file = folder / "ping_results_half.txt"
    for text in ("1\n2\n3", "1\n2\n34\n5\n", "7\n", "7\n8\n", ""):
        file.write_text(text)
        assert series(ingest_runs(spark, table, f"{root}/results_*")) == series(scan_runs(spark, f"{root}/results_*"))


def test_what_a_broken_ingest_left_is_removed(spark, root, tmp_path, monkeypatch):
    from hoplens.plans import ingest

    table = str(tmp_path / "table")
    file = root / f"results_{FIRST}" / "ping_results_8.8.8.8.txt"
    ingest_runs(spark, table, f"{root}/results_*")
    with file.open("a") as lines:
        lines.write("\n1\n")
    with monkeypatch.context() as broken:
        broken.setattr(ingest, "_commit", lambda *rest: 1 / 0)
        for _ in range(2):
            with pytest.raises(ZeroDivisionError):
                ingest_runs(spark, table, f"{root}/results_*")
    assert series(ingest_runs(spark, table, f"{root}/results_*")) == series(scan_runs(spark, f"{root}/results_*"))


def test_partials_of_several_ingests_add_up(spark, tmp_path):
    folder, table = tmp_path / f"results_{FIRST}", str(tmp_path / "table")
    folder.mkdir()
    for step in range(4):
        for name, longest in (("x", 700), ("y", 90)):
            with (folder / f"ping_results_{name}.txt").open("a") as file:
                file.writelines(f"{(n * 37) % 900}\n" if n % 5 else "Lost\n" if n % 2 else "bad\n" for n in range(step, longest + step))
        ingest_runs(spark, table, f"{tmp_path}/results_*")
    samples, rows = read_samples(spark, table), read_partials(spark, table)
    assert rows.groupBy("run_id", "target", "block").count().where("count > 1").isEmpty()
    expected = spark.createDataFrame([("x",), ("absent",)], "target string")
    direct, summed = analyse(samples, expected=expected), analyse(samples, expected=expected, partials=rows)
    assert direct.summary.count() == 2 and direct.lost_windows.columns == summed.lost_windows.columns
    for name, part in direct._asdict().items():
        assert same(part, getattr(summed, name)), name


def rounded(frame):
    return sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in row)) for row in frame.collect())


def same(one, other):
    return one.columns == other.columns and rounded(one) == rounded(other)


def test_partials_of_nan_and_infinity(spark):
    data = model.random_data(21, nan=0.3)
    data["run0"]["odd"] = [float("inf"), None, float("-inf"), float("nan")] * 40 + [None] * 80
    samples = model.frame(spark, data)
    for repair in (True, False):
        direct, summed = analyse(samples, repair_nan=repair), analyse(samples, repair_nan=repair, partials=partials(samples))
        for name, part in direct._asdict().items():
            # A mean that lies between two texts may take either, by the order that it was added up in.
            assert name == "summary_text" or same(part, getattr(summed, name)), name


def test_a_report_from_partials_reads_samples_for_series_and_regions_alone(spark, tmp_path):
    samples = model.frame(spark, model.random_data(3))
    samples.write.parquet(str(tmp_path / "samples"))
    samples = spark.read.parquet(str(tmp_path / "samples"))
    partials(samples).write.parquet(str(tmp_path / "partials"))
    report = analyse(samples, partials=spark.read.parquet(str(tmp_path / "partials")))
    for name, part in report._asdict().items():
        assert any("/samples/" in file for file in part.inputFiles()) == (name in ("raw_series", "regions")), name


def test_appends_are_read_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("hoplens.sources.sinks.TEXT_BLOCK", 10)
    path = str(tmp_path / "text")
    for first, last in ((0, 35), (35, 90), (90, 95), (95, 96)):
        rows = [("r", target, n - first + 1, float(n)) for target in ("a", ":b") for n in range(first, last)]
        write_text(spark.createDataFrame(rows, "run_id string, target string, seq long, latency_ms double").repartition(3), path)
    back = scan_partitioned(spark, path)
    assert back.count() == 192 and back.where("seq <> latency_ms + 1").isEmpty()
    assert [row.number for row in write_log(spark, path).orderBy("number").collect()] == [0, 1, 2, 3]
    write_text(spark.createDataFrame([("r", "a", 1, 5.0)], "run_id string, target string, seq long, latency_ms double"), path, "overwrite")
    assert [row.latency_ms for row in scan_partitioned(spark, path).collect()] == [5.0] and write_log(spark, path).count() == 1


def test_a_write_that_was_not_logged_takes_its_place_later(spark, tmp_path):
    path = str(tmp_path / "text")
    schema = "run_id string, target string, seq long, latency_ms double"
    for number in range(2):
        write_text(spark.createDataFrame([("r", "a", 1, float(number))], schema), path)
    remove(spark, f"{path}/_writes")
    write_text(spark.createDataFrame([("r", "a", 1, 2.0)], schema), path)
    assert [row.latency_ms for row in scan_partitioned(spark, path).orderBy("seq").collect()] == [0.0, 1.0, 2.0]


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_each_line_belongs_to_one_range(monkeypatch, size):
    monkeypatch.setattr(appended, "READ_BYTES", size)
    text = b"1\n\n22\r\n333\n4444444444\nopen"
    whole = list(appended.lines_between(io.BytesIO(text), 0, len(text)))
    assert [line for _, line in whole] == [b"1", b"", b"22\r", b"333", b"4444444444"]
    for cut in range(len(text) + 1):
        parts = [*appended.lines_between(io.BytesIO(text), 0, cut), *appended.lines_between(io.BytesIO(text), cut, len(text))]
        assert parts == whole


def test_a_runs_clock_and_axis(spark):
    rows = spark.createDataFrame([(FIRST, 1), (f"site/{FIRST}", 61), ("by hand", 3)], "run_id string, seq long")
    found = rows.select(run_clock(F.col("run_id")).cast("string"), probe_clock(F.col("run_id"), F.col("seq"), 2).cast("string"), elapsed(F.col("seq"), 2))
    assert [tuple(row) for row in found.collect()] == [
        ("2023-10-05 12:00:00", "2023-10-05 12:00:00", 2), ("2023-10-05 12:00:00", "2023-10-05 12:02:00", 122), (None, None, 6)
    ]


def test_ingesting_again_changes_nothing(spark, root, tmp_path):
    table = str(tmp_path / "table")
    first = series(ingest_runs(spark, table, f"{root}/results_*"))
    assert series(ingest_runs(spark, table, f"{root}/results_{FIRST}")) == first


def test_empty_keys_come_back(spark, tmp_path):
    samples = spark.createDataFrame([("r", "", 1, 5.0), ("r", "a", 1, 6.0)], "run_id string, target string, seq bigint, latency_ms double")
    write_text(samples, str(tmp_path / "text"))
    assert {row.target for row in scan_partitioned(spark, str(tmp_path / "text")).collect()} == {"", "a"}
    assert [row.latency_ms for row in scan_partitioned(spark, str(tmp_path / "text"), "target = ''").collect()] == [5.0]


def test_ingest_and_analyse(spark, root, tmp_path):
    table = ingest_runs(spark, str(tmp_path / "table"), f"{root}/results_{FIRST}")
    ingest_runs(spark, str(tmp_path / "table"), f"{root}/results_2023-10-06*")
    assert table.columns == SAMPLES.names
    again = read_samples(spark, str(tmp_path / "table"))
    assert series(again) == series(scan_runs(spark, f"{root}/results_*"))
    direct = analyse_runs(spark, f"{root}/results_*", settings=Settings(latency_threshold=24.5))
    assert direct.summary.exceptAll(analyse(again).summary).isEmpty() and direct.summary.count() == 3
    file = analyse_file(spark, f"{root}/results_{FIRST}/ping_results_8.8.8.8.txt", Settings(latency_threshold=24.5))
    assert [(row.start_s, row.end_s) for row in file.regions.collect()] == [(3, 5)]
    nothing = analyse_file(spark, f"{root}/nothing.txt")
    assert all(frame.count() == 0 for frame in nothing)


def test_lines_are_stripped_once(spark):
    lines = spark.createDataFrame([("1",)], "value string")
    plan = parse_lines(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_many_series_are_read_without_comparing_their_folders(spark, tmp_path):
    """Tasks deal the files out, no folder is made out to be a column, and a write that was broken off is found later."""
    path = str(tmp_path / "text")
    targets = [None, "", "a b", "x+y", "50%", "::1", "ä"]
    samples = spark.createDataFrame(
        [("r", target, n, float(n)) for target in targets for n in (1, 2)], "run_id string, target string, seq long, latency_ms double"
    )
    write_text(samples.where("target IS NOT NULL"), path)
    (tmp_path / "text" / "_staged" / "broken").mkdir(parents=True)
    remove(spark, f"{path}/_writes")
    write_text(samples.where("target IS NULL"), path)
    write_text(samples.where("seq = 1"), path)
    assert not (tmp_path / "text" / "_staged").exists() and write_log(spark, path).count() == 3
    assert not list((tmp_path / "text" / "run_id=r").rglob("*.crc"))
    back = scan_partitioned(spark, path)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" in plan and "target=%" not in plan and "ReadSchema: struct<value:string>" in plan and "Window" not in plan.split("Join")[0]
    found = back.collect()
    rows = {target: sorted((row.seq, row.latency_ms) for row in found if row.target == target) for target in {row.target for row in found}}
    three = [(1, 1.0), (2, 2.0), (3, 1.0)]
    assert rows == {target: three for target in ("a b", "x+y", "50%", "::1", "ä")} | {"": list(enumerate([1.0, 2.0, 1.0, 2.0, 1.0, 1.0], 1))}
    assert read_lines(spark, path).where("target IS NULL").count() == 6


def test_lines_of_a_split_are_not_sorted(spark, conf, tmp_path):
    """Ids rank the lines of a split file, so no task holds a split to sort it."""
    folder = tmp_path / "results_2024-01-01_00-00-00"
    folder.mkdir()
    (folder / "ping_results_a.txt").write_text("".join(f"{n}\n" for n in range(1, 4001)))
    conf("spark.sql.files.maxPartitionBytes", "1000")
    one = scan_file(spark, str(folder / "ping_results_a.txt"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and "_n" in plan.split("Window [")[1].split("\n")[0]
    assert one.count() == 4000 and one.where("seq <> latency_ms").isEmpty()
