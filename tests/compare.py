"""Compare registered queries with their SQL: python tests/compare.py [sf] [names...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent.parent))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    """Values as comparable text; numbers to 9 significant digits."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.12g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, con, name, run, sql, folder):
    """None when equal, else what differs."""
    df = run(spark, folder)
    mine, names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if mine else "no rows"
    cur = con.execute(sql)
    theirs, their_names = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != their_names:
        return f"columns {names} != {their_names}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    if not mine:
        return "both empty"
    return f"{len(bad)} of {len(mine)} rows differ, e.g.\n   {bad[0][0]}\n   {bad[0][1]}" if bad else None


def main() -> int:
    from conftest import make_session

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    chosen = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark, con = make_session(), duck(folder)
    failed = 0
    for name, run in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, run, entry.oracle_sql().get(name), folder)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        kind = "H" if name in entry.oracle_sql() else "R"
        print(f"{'ok ' if problem is None else 'BAD'} {kind} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
