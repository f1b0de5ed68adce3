"""Compare registered queries with their SQL twins in DuckDB.

    python tests/parity.py 0.01 [query ...]
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
DATA = "/root/testdata"


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if value is not None and type(value).__name__ == "Decimal":
        return float(value)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is not None, str(type(v)), v) if not isinstance(v, (int, float)) else (True, "n", v) for v in r))


def differences(df, con, sql: str, limit: int = 3) -> list[str]:
    """Human-readable differences, empty when both sides agree."""
    left_names = df.columns
    left = _rows(left_names, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right_names = [d[0] for d in cur.description]
    right = _rows(right_names, cur.fetchall())
    if sorted(left_names) != sorted(right_names):
        return [f"columns {sorted(left_names)} / {sorted(right_names)}"]
    if len(left) != len(right):
        return [f"rows {len(left)} / {len(right)}", f"{left[:2]}", f"{right[:2]}"]
    if not left:
        return ["no rows"]
    bad = [f"{a} / {b}" for a, b in zip(left, right) if a != b]
    return [f"{len(bad)} of {len(left)} rows differ", *bad[:limit]] if bad else []


def main(scale: str, wanted: list[str]) -> int:
    from panelkit.queries import QUERIES, SQL
    from panelkit.session import local_session

    sf = f"{DATA}/sf{scale}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = 0
    for name, fn in QUERIES.items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            if name in SQL:
                found = differences(fn(spark, sf), con, SQL[name])
            else:
                rows = fn(spark, sf).count()
                found = [] if rows else ["no rows"]
        except Exception as err:  # report and go on
            found = [f"{type(err).__name__}: {str(err)[:1500]}"]
        mark = "FAIL" if found else ("ok  " if name in SQL else "rows")
        print(f"{mark} {name} {time.time() - began:.1f}s", flush=True)
        for line in found:
            print("     ", line[:1500], flush=True)
        failed += bool(found)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 100))
