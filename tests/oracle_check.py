"""Compare registered queries with their SQL. ``python tests/oracle_check.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import __spark_entry__ as contract  # noqa: E402
from wordprism.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
ROOT = os.environ.get("WORDPRISM_TESTDATA", "/root/testdata")


def database(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set threads = 8")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{ROOT}/{sf}/{name}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    columns = []
    for name in frame.columns:
        column = frame[name]
        if column.dtype.kind == "f":
            columns.append([None if pd.isna(v) else float(v) for v in column])
        else:
            columns.append([None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else v for v in column])
    rows = [tuple(x.item() if hasattr(x, "item") else (tuple(x) if isinstance(x, list) else x) for x in r) for r in zip(*columns)]
    return sorted(rows, key=repr)


def same_hashes(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    def hashes(frame: pd.DataFrame):
        frame = frame[sorted(frame.columns)]
        frame = frame.apply(lambda c: c.map(lambda v: v if isinstance(v, str) else repr(v)) if c.dtype == object else c)
        return sorted(pd.util.hash_pandas_object(frame, index=False).tolist())

    return len(a) == len(b) and hashes(a) == hashes(b)


def compare(spark, con, name: str, sf: str) -> str | None:
    """None when equal, else what differs."""
    got = contract.queries()[name](spark, f"{ROOT}/{sf}").toPandas()
    expected = con.execute(contract.oracle_sql()[name]).df()
    if sorted(got.columns) != sorted(expected.columns):
        return f"columns {sorted(got.columns)} and {sorted(expected.columns)}"
    kinds = {c: (got[c].dtype.kind, expected[c].dtype.kind) for c in got.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and not (set(k) == {"f", "i"} and got[c].isna().any())}
    if not odd and len(got) and same_hashes(got, expected):
        return None
    a, b = normal(got), normal(expected)
    if a != b:
        only_a, only_b = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
        return f"{len(a)} and {len(b)} rows; only here {only_a}; only in SQL {only_b}; {odd}"
    if odd:
        return f"equal values, other types {odd}"
    if not a:
        return "equal, but empty"
    return None


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    names = sys.argv[2:] or list(contract.queries())
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = database(sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in contract.oracle_sql():
                result = compare(spark, con, name, sf)
                note = "ok" if result is None else f"DIFFERS: {result}"
            else:
                note = f"rows only: {contract.queries()[name](spark, f'{ROOT}/{sf}').count()}"
        except Exception as error:  # noqa: BLE001
            note = "ERROR " + str(error)[:600]
        bad += note.startswith(("DIFF", "ERR"))
        print(f"{name:28s} {time.time() - start:6.1f}s {note[:900]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
