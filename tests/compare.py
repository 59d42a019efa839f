"""Run registered queries beside their SQL and compare rows.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    if hasattr(value, "is_finite"):
        return float(value)
    return value


def shaped(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tuples = [tuple(cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(tuples, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def differences(spark_df, con, sql: str) -> list[str]:
    ours_columns = spark_df.columns
    ours = shaped(ours_columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    theirs_columns = [d[0] for d in cursor.description]
    theirs = shaped(theirs_columns, cursor.fetchall())
    found = []
    if ours[0] != theirs[0]:
        return [f"columns {ours[0]} vs {theirs[0]}"]
    if len(ours[1]) != len(theirs[1]):
        found.append(f"rows {len(ours[1])} vs {len(theirs[1])}")
    if ours[1] and theirs[1]:
        for a, b in zip(ours[1], theirs[1]):
            if a != b or [type(x) for x in a] != [type(x) for x in b]:
                found.append(f"  ours   {a}\n  theirs {b}")
                if len(found) > 3:
                    break
    elif ours[1] != theirs[1]:
        found.append("one side is empty")
    if not ours[1]:
        found.append("no rows")
    return found


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as contract
    from plumbline.session import local_session

    spark = local_session("compare")
    con = connect(args.sf)
    queries, sql = contract.queries(), contract.oracle_sql()
    bad, total = 0, 0.0
    for name in args.names or queries:
        start = time.time()
        try:
            df = queries[name](spark, args.sf)
            problems = differences(df, con, sql[name]) if name in sql else ([] if df.collect() else ["no rows"])
        except Exception as error:  # noqa: BLE001 - the report goes on
            problems = [f"{type(error).__name__}: {str(error)[:900]}"]
        took = time.time() - start
        total += took
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '}{name:28s}{took:6.2f}s{'' if name in sql else '  (rows only)'}", flush=True)
        for p in problems:
            print("   ", p)
    print(f"{bad} bad of {len(args.names or queries)}, {total:.0f} s")
    return bad


if __name__ == "__main__":
    sys.exit(main())
