import ipaddress
import math
import random

import pytest
from pyspark.sql import functions as F

from hoplens.functions.hosts import is_host, is_ipv4
from hoplens.functions.parsing import (
    decoded_path, parse_lines, probe_latency, run_clock, run_from_path, target_from_name, target_from_path,
)
from hoplens.operators import hosts


def parse(spark, lines):
    frame = spark.createDataFrame([(n, line) for n, line in enumerate(lines)], "n int, value string")
    return [(row.latency_ms, row.malformed) for row in parse_lines(frame).orderBy("n").collect()]


def same(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


def expected(line):
    text = line.strip()
    try:
        return float(text), False
    except ValueError:
        return None, text.lower() != "lost"


FIXED = [
    ("23.5", 23.5, False), (" LOST ", None, False), ("lost", None, False), ("", None, True),
    ("Error: [Errno 2] x", None, True), ("1_000", 1000.0, False), ("1d", None, True), ("1.5f", None, True),
    ("0x1p3", None, True), ("1,5", None, True), ("1__0", None, True), ("_1", None, True), ("1_", None, True),
    ("+5", 5.0, False), (".5", 0.5, False), ("5.", 5.0, False), ("1e3", 1000.0, False), ("1e999", math.inf, False),
    ("1_0.0_1e1_0", 10.01e10, False), (".", None, True), ("e5", None, True), ("1e", None, True), ("+-5", None, True),
    ("nan", math.nan, False), ("-NaN", math.nan, False), ("+nan", math.nan, False), ("inf", math.inf, False),
    ("+Infinity", math.inf, False), ("-Infinity", -math.inf, False), ("-inf", -math.inf, False), ("+-inf", None, True),
    ("++inf", None, True), ("infin", None, True), ("\x1f 7 \x85", 7.0, False), (" 12　", 12.0, False),
    ("12\n", 12.0, False), ("1 2", None, True), ("Lost!", None, True), ("l ost", None, True),
]


def test_fixed_lines(spark):
    got = parse(spark, [line for line, *_ in FIXED])
    for (line, latency, malformed), (found, flag) in zip(FIXED, got):
        assert same(found, latency) and flag is malformed, line


def test_agrees_with_python_float(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choices("0123456789.eE+-_ nafiNdfxlostLO\t", k=rng.randint(0, 7))) for _ in range(4000)]
    lines += [f"{rng.uniform(-1e6, 1e6)!r}" for _ in range(500)]
    lines += ["".join(rng.choices("019.e+-_", k=rng.randint(1, 6))) for _ in range(4000)]
    for line, got in zip(lines, parse(spark, lines)):
        want = expected(line)
        assert same(got[0], want[0]) and got[1] is want[1], repr(line)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(
    "output, code, unix, windows",
    [
        ("64 bytes from 8.8.8.8: icmp_seq=1 ttl=56 time=23.5 ms", 0, 23.5, None),
        ("Reply from 1.1.1.1: bytes=32 time<1ms TTL=50", 0, None, 1.0),
        ("Reply from 1.1.1.1: bytes=32 time=14ms TTL=50", 0, 14.0, 14.0),
        ("Request timed out", 1, None, None),
        ("time=23.5 ms", 1, None, None),
        ("time = 7. ms then time=9 ms", 0, 7.0, None),
    ],
)
def test_probe_output(spark, output, code, unix, windows):
    columns = [probe_latency(F.lit(output), F.lit(code), kind) for kind in ("unix", "windows")]
    assert one(spark, *columns) == (unix, windows)


def test_names_and_paths(spark):
    names = ["ping_results_8.8.8.8.txt", "ping_results_a_b.txt", "ping_results_.txt", "ping_results.txt", "x.txt", "ping_results_a.csv"]
    assert one(spark, *[target_from_name(F.lit(name)) for name in names]) == ("8.8.8.8", "a_b", "", None, None, None)
    path = F.lit("/r/results_2023-10-05_12-00-01/ping_results_8.8.8.8.txt")
    assert one(spark, run_from_path(path), target_from_path(path)) == ("2023-10-05_12-00-01", "8.8.8.8")
    assert one(spark, run_from_path(F.lit("/r/results_2023-10-05/x.txt")))[0] == "results_2023-10-05"
    assert str(one(spark, run_clock(F.lit("2023-10-05_12-00-01")))[0]) == "2023-10-05 12:00:01"
    assert one(spark, run_clock(F.lit("2023-13-05_12-00-01")), run_clock(F.lit("by hand"))) == (None, None)
    assert one(spark, decoded_path(F.lit("file:/a%20b/c+d%25")), decoded_path(F.lit("/a+b"))) == ("file:/a b/c+d%", "/a+b")


def is_address(text):
    try:
        return ipaddress.ip_address(text).version
    except ValueError:
        return None


def test_hosts_agree_with_ipaddress(spark):
    rng = random.Random(5)
    texts = ["8.8.8.8", "1.1.1.1", "invalid_ip", "::1", "::", "256.1.1.1", "01.1.1.1", "1.2.3", "1.2.3.4.5", "", "1.2.3.4\n",
             "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:",
             "1:2:3:4:5:6:7:8:9", "1:2:3:4::5:6:7:8", "::ffff:1.2.3.4", "::ffff:01.2.3.4", "1.2.3.4::", "1:2:3:4:5:6:1.2.3.4",
             "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.4:5", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", "%eth0", "::1/64", "fe80::1%a/b",
             "12345::", ":::", ":", "::g", "ABCD::ef", " ::1", "1.2.3.4%eth0", "::%1", "::1.2.3.4%x", "1.2.3.4 "]
    texts += ["".join(rng.choices("012:::.af%5", k=rng.randint(1, 12))) for _ in range(6000)]
    texts += [":".join(rng.choice(["", "1", "ff", "abcd"]) for _ in range(rng.randint(2, 10))) for _ in range(4000)]
    texts += [".".join(rng.choice(["0", "1", "00", "99", "100", "199", "249", "255", "256", "1000"]) for _ in range(4)) for _ in range(1000)]
    rows = spark.createDataFrame([(text,) for text in texts], "h string").select(
        "h", is_host(F.col("h")).alias("valid"), is_ipv4(F.col("h")).alias("v4")
    ).collect()
    for row in rows:
        version = is_address(row.h)
        assert row.valid == (version is not None) and row.v4 == (version == 4), repr(row.h)


def test_host_lists(spark):
    given = hosts.host_list(spark, ["8.8.8.8", "invalid_ip", "8.8.8.8", "1.1.1.1"])
    valid = [row.target for row in hosts.valid_targets(given).orderBy("position").collect()]
    assert valid == ["8.8.8.8", "8.8.8.8", "1.1.1.1"]
    assert [row.target for row in hosts.invalid_targets(given).collect()] == ["invalid_ip"]
    assert [row.target for row in hosts.host_list(spark, []).collect()] == ["8.8.8.8"]
    assert hosts.require_valid_targets(given).count() == 3
    with pytest.raises(ValueError):
        hosts.require_valid_targets(hosts.host_list(spark, ["invalid_ip1", "invalid_ip2"]))
    checked = {row.target: (row.is_valid, row.version) for row in hosts.check_hosts(hosts.host_list(spark, ["::1", "1.1.1.1", "x"])).collect()}
    assert checked == {"::1": (True, 6), "1.1.1.1": (True, 4), "x": (False, None)}
