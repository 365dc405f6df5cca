"""Runs a Spark query and its DuckDB twin and compares rows regardless of order."""

import glob
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connection(sf_dir=SF):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return con


def _plain(value):
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((repr(tuple(_plain(r[i]) for i in order)) for r in rows))


def differences(spark_df, sql, sf_dir=SF):
    """An empty list if both give the same columns and rows."""
    con = connection(sf_dir)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = _rows(names, found.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} against {sorted(names)}"]
    got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got == want:
        return []
    only_got, only_want = list(set(got) - set(want))[:3], list(set(want) - set(got))[:3]
    return [f"{len(got)} rows against {len(want)}", *(f"spark {x}" for x in only_got), *(f"sql   {x}" for x in only_want)]
