"""Run registered queries next to their SQL statements and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels
conversations""".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, float):
        return "∅" if math.isnan(v) else f"f{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + "|".join(_norm(x) for x in v) + "]"
    return f"s{v}"


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(_norm(r[i]) for i in order) for r in rows])


def compare(df, con, sql) -> str | None:
    """None when both sides agree, else a short description."""
    got = _table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = _table([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}; e.g. {got[1][:1]} / {want[1][:1]}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return f"{len(bad)} rows differ, first: {str(bad[0])[:600]}" if bad else None


def main(sf_dir: str, names: list[str]) -> None:
    import __spark_entry__ as entry
    from venuekit.session import local_session

    spark = local_session(8)
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not names or any(n.startswith(p) for p in names)]
    failed = 0
    for name in chosen:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                rows = df.collect()
                problem = None if rows else "no rows"
                print(f"   {name}: {len(rows)} rows, {str(rows[:2])[:300]}")
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(chosen)} queries, {failed} failed")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
