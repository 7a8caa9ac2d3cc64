"""Compare registered queries with their SQL in DuckDB."""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        if frame[name].dtype.kind == "M":
            frame[name] = frame[name].astype("datetime64[us]")
        if pd.api.types.is_extension_array_dtype(frame[name].dtype) and frame[name].dtype.kind == "i":  # whole numbers with nulls
            frame[name] = frame[name].astype("float64")
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def difference(spark, connection, query, sql: str, sf_dir: str) -> str | None:
    """What differs, or None if rows, names, types and values agree."""
    result = query(spark, sf_dir)
    got, want = plain(result.toPandas()), plain(connection.sql(sql).df())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} against {list(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    kinds = {
        name: (got[name].dtype, want[name].dtype)
        for name in got.columns
        if got[name].dtype.kind != want[name].dtype.kind and not {got[name].dtype.kind, want[name].dtype.kind} <= set("OSTU")
    }
    if kinds:
        return f"types {kinds}"
    try:
        pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)
    except AssertionError as error:
        return str(error)[:1500]
    return None


def main(names: list[str], sf_dir: str = "/root/testdata/sf0.01") -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from hoplens.session import local_session

    spark, connection = local_session(), connect(sf_dir)
    failed = 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            found = difference(spark, connection, query, entry.oracle_sql()[name], sf_dir)
        except Exception as error:  # report every query
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += found is not None
        print(f"{name:26s} {time.time() - start:6.2f}s {found or 'ok'}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
