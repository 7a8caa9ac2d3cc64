"""Lines appended to text result files, read by byte ranges so that no byte is read twice.

A line belongs to the range that its line end lies in. So a file may grow between two reads in the middle of a line: the line is
handed out whole, once, by the range that has its end, which looks back for its beginning.
"""

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from hoplens.functions.parsing import parse_lines, run_from_path, target_from_path

FORMAT = "appended_lines"
SCHEMA = "path string, at bigint, value string"
# Bytes of a file that one task reads, and that are read at a time.
RANGE_BYTES = 64 << 20
READ_BYTES = 1 << 20
BATCH_LINES = 10_000


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it. Names may hold any sign: only what stands before them is read as an address."""
    scheme, mark, rest = path.partition(":/")
    if not mark or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    host, _, below = rest.lstrip("/").partition("/")
    store, root = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return store, f"{root.rstrip('/')}/{below}"


def lines_between(source, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """Place and content of the lines whose line end lies in ``start`` to ``stop``."""
    at, held = start, b""
    while at > 0:
        first = max(0, at - READ_BYTES)
        source.seek(first)
        back = source.read(at - first)
        end = back.rfind(b"\n")
        held = back[end + 1 :] + held
        at = first + end + 1
        if end >= 0:
            break
    source.seek(start)
    place = start
    while place < stop:
        data = source.read(min(READ_BYTES, stop - place))
        if not data:
            return
        place += len(data)
        *lines, held = (held + data).split(b"\n")
        for line in lines:
            yield at, line
            at += len(line) + 1


def _texts(at: int, line: bytes) -> Iterator[tuple[int, str]]:
    """What Spark's text reader gives: a carriage return ends a line too, and a mark at the front of a file is dropped."""
    if not at:
        line = line.removeprefix(b"\xef\xbb\xbf")
    if b"\r" not in line:
        yield at, line.decode(errors="replace")
        return
    for part in line.removesuffix(b"\r").split(b"\r"):
        yield at, part.decode(errors="replace")
        at += len(part) + 1


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class AppendedLines(DataSource):
    """A stream of the lines that files get. Options: ``folder``, a folder or a pattern of its last name; ``files``, a pattern
    of names; ``state``, a folder that keeps the files' sizes at each offset."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> "AppendedReader":
        return AppendedReader(self.options)


class AppendedReader(DataSourceStreamReader):
    """An offset is the number of a snapshot of all files' sizes, so it stays small however many files there are.

    A snapshot is written before its number is given out, and never changed: a batch that is planned again reads the same ranges.
    """

    def __init__(self, options: dict):
        self.folder, self.files, self.state = options["folder"].rstrip("/"), options["files"], options["state"].rstrip("/")

    def _snapshot(self, number: int) -> dict[str, int]:
        if number == 0:
            return {}
        store, root = store_of(self.state)
        with store.open_input_file(f"{root}/sizes-{number:012d}.json") as file:
            return json.loads(file.read())

    def _snapshots(self) -> list[int]:
        store, root = store_of(self.state)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        names = [re.fullmatch(r"sizes-([0-9]+)\.json", info.base_name) for info in found]
        return sorted(int(name[1]) for name in names if name)

    def _sizes(self) -> dict[str, int]:
        store, root = store_of(self.folder)
        above, _, last = root.rpartition("/")
        names = re.compile("".join(".*" if sign == "*" else re.escape(sign) for sign in self.files))
        wanted = re.compile("".join(".*" if sign == "*" else re.escape(sign) for sign in last))
        roots = [root]
        if "*" in last:
            roots = [
                info.path
                for info in store.get_file_info(fs.FileSelector(above, allow_not_found=True))
                if info.type == fs.FileType.Directory and wanted.fullmatch(info.base_name)
            ]
        found = [info for place in roots for info in store.get_file_info(fs.FileSelector(place, allow_not_found=True))]
        return {info.path: info.size for info in found if info.type == fs.FileType.File and names.fullmatch(info.base_name)}

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        last = max([0, *self._snapshots()])
        before, now = self._snapshot(last), self._sizes()
        # A file that is gone stays known, so that one of its name does not count as new.
        sizes = before | {path: max(size, before.get(path, 0)) for path, size in now.items()}
        if sizes != before:
            store, root = store_of(self.state)
            store.create_dir(root, recursive=True)
            last += 1
            whole = f"{root}/sizes-{last:012d}.json"
            with store.open_output_stream(f"{whole}.part") as file:
                file.write(json.dumps(sizes).encode())
            store.move(f"{whole}.part", whole)
        return {"snapshot": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, now = self._snapshot(start["snapshot"]), self._snapshot(end["snapshot"])
        return [
            _Range(path, first, min(size, first + RANGE_BYTES))
            for path, size in now.items()
            for first in range(before.get(path, 0), size, RANGE_BYTES)
        ]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.folder)
        with store.open_input_file(partition.path) as source:
            yield from _batches(partition.path, lines_between(source, partition.start, partition.stop))

    def commit(self, end: dict) -> None:
        store, root = store_of(self.state)
        for number in self._snapshots():
            if number < end["snapshot"] - 1:
                store.delete_file(f"{root}/sizes-{number:012d}.json")


def _batches(path: str, lines: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    at, values = [], []
    for place, line in lines:
        for where, text in _texts(place, line):
            at.append(where)
            values.append(text)
        if len(at) >= BATCH_LINES:
            yield _batch(path, at, values)
            at, values = [], []
    if at:
        yield _batch(path, at, values)


def _batch(path: str, at: list[int], values: list[str]) -> pa.RecordBatch:
    columns = [pa.array([path] * len(at)), pa.array(at, pa.int64()), pa.array(values)]
    return pa.RecordBatch.from_arrays(columns, names=["path", "at", "value"])


def appended_stream(spark: SparkSession, folder: str, state: str, files: str = "ping_results_*.txt") -> DataFrame:
    """Samples of result files as lines are appended: ``run_id, target, at, latency_ms, malformed``.

    ``folder`` is a run folder or a pattern of run folders' names; files and folders that come later are found. ``at`` is the byte that a
    line begins at and orders the lines of a file. A line without a line end is still being written and waits for it. Files only
    grow. ``state`` belongs to one query, as its checkpoint does.
    """
    spark.dataSource.register(AppendedLines)
    reader = spark.readStream.format(FORMAT).option("folder", folder).option("files", files).option("state", state)
    lines = reader.load().select(
        run_from_path(F.col("path")).alias("run_id"), target_from_path(F.col("path")).alias("target"), "at", "value"
    )
    return parse_lines(lines)


def read_ranges(ranges: DataFrame) -> DataFrame:
    """Lines of ``path, start, stop``: ``path, at, value``. A last line without a line end counts as one.

    ``start`` is a line's beginning. Long ranges are cut, so one file may be read by many tasks.
    """
    steps = F.explode(F.sequence(F.col("start"), F.col("stop") - 1, F.lit(RANGE_BYTES).cast("long")))
    parts = ranges.where("start < stop").withColumn("first", steps).select(
        "path", "first", F.least("stop", F.col("first") + RANGE_BYTES).alias("end"), (F.col("first") + RANGE_BYTES >= F.col("stop")).alias("last")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = store_of(row["path"])
                with store.open_input_file(path) as source:
                    yield from _batches(row["path"], lines_between(source, row["first"], row["end"]))
                    rest = _open_line(source, row["end"]) if row["last"] else None
                    if rest and rest[1]:
                        yield from _batches(row["path"], iter([rest]))

    return parts.repartition("path", "first").mapInArrow(read, SCHEMA)


def _open_line(source, stop: int) -> tuple[int, bytes]:
    """What stands before ``stop`` behind the last line end."""
    held, at = b"", stop
    while at > 0:
        first = max(0, at - READ_BYTES)
        source.seek(first)
        back = source.read(at - first)
        end = back.rfind(b"\n")
        held = back[end + 1 :] + held
        if end >= 0:
            return first + end + 1, held
        at = first
    return 0, held


def ended(files: DataFrame) -> DataFrame:
    """Which of the files (``path, bytes``) end with a line end at that size; empty ones do."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                store, path = store_of(row["path"])
                if row["bytes"]:
                    with store.open_input_file(path) as source:
                        source.seek(row["bytes"] - 1)
                        found.append(source.read(1) == b"\n")
                else:
                    found.append(True)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.bool_())], names=["path", "ended"])

    return files.select("path", "bytes").mapInArrow(look, "path string, ended boolean")
