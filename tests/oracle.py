"""Run registered queries next to their SQL in DuckDB and compare the rows.

    python tests/oracle.py [--sf DIR] [name part ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, cell(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    keyed = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(keyed, key=repr)


def compare(df, con, sql) -> str | None:
    """None if both sides agree, else what differs."""
    ours_cols, ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs_cols, theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if ours_cols != theirs_cols:
        return f"columns {ours_cols} != {theirs_cols}"
    if len(ours) != len(theirs):
        extra = set(ours) - set(theirs)
        return f"{len(ours)} rows != {len(theirs)}; ours only {repr(sorted(extra, key=repr)[:2])[:400]}"
    bad = [(a, b) for a, b in zip(ours, theirs) if not same(a, b)]
    return f"{len(bad)} rows differ, first {repr(bad[0])[:700]}" if bad else None


def same(a, b) -> bool:
    for x, y in zip(a, b):
        if isinstance(x, float) and isinstance(y, float):
            if not math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6):
                return False
        elif type(x) is not type(y) or x != y:
            return False
    return True


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from moodmill.session import local_session

    sf = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    spark = local_session("oracle", 8)
    con, sqls, failed = connect(sf), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if argv and not any(a in name for a in argv):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            problem = compare(df, con, sqls[name]) if name in sqls else None
            note = "ok" if name in sqls else f"rows {df.count()}"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else note:10} {time.time() - start:6.1f}s {name} {problem or ''}", flush=True)
    print(f"{failed} failed")
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
