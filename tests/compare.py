"""Run registered queries in Spark and DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def database(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, Decimal):
        return "dec" + str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat(" ")
    if isinstance(v, dict):
        return str({k: _plain(x) for k, x in v.items()})
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return str([_plain(x) for x in v])
    return f"{type(v).__name__}:{v}"


def _rows(arrow):
    names = sorted(arrow.column_names)
    cols = [arrow.column(n).to_pylist() for n in names]
    return names, sorted(tuple(_plain(v) for v in row) for row in zip(*cols))


def _last_digit_only(a, b) -> bool:
    """Same rows but for the last rounded digit: engines add doubles in another order, and ties then round apart."""

    def in_order(arrow):
        cols = [arrow.column(n).to_pylist() for n in sorted(arrow.column_names)]
        exact = [c for c in cols if not any(isinstance(v, float) for v in c)]
        loose = [c for c in cols if any(isinstance(v, float) for v in c)]
        n = arrow.num_rows
        keys = [(tuple(_plain(c[i]) for c in exact), tuple(-math.inf if c[i] is None else c[i] for c in loose)) for i in range(n)]
        return sorted(keys)

    x, y = in_order(a), in_order(b)
    return len(x) == len(y) and all(
        p[0] == q[0] and len(p[1]) == len(q[1]) and all(math.isclose(u, v, rel_tol=1e-9, abs_tol=1.01e-6) for u, v in zip(p[1], q[1]))
        for p, q in zip(x, y)
    )


def compare(spark, con, sf, query, exact=True):
    mine = query.run(spark, sf).toArrow()
    got = _rows(mine)
    if query.sql is None:
        return None, len(got[1])
    theirs = con.execute(query.sql).to_arrow_table()
    want = _rows(theirs)
    if not exact and got[0] == want[0] and got[1] != want[1] and _last_digit_only(mine, theirs):
        return None, len(got[1])
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1])
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return f"rows {len(got[1])} vs {len(want[1])}; spark only {sorted(a - b)[:2]}; sql only {sorted(b - a)[:2]}", len(got[1])
    return None, len(got[1])


def main(argv):
    from headway.catalog import load
    from headway.session import build_session

    sf = "/root/testdata/" + (argv[0] if argv else "sf0.01")
    pick = argv[1:]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = database(sf)
    bad = 0
    for name, q in load().items():
        if pick and not any(name == p or (p.endswith("*") and name.startswith(p[:-1])) or q.module == p for p in pick):
            continue
        t = time.time()
        try:
            err, n = compare(spark, con, sf, q)
        except Exception as e:  # noqa: BLE001
            err, n = f"{type(e).__name__} {str(e)[:900]}", -1
        bad += err is not None
        mark = "ok " if err is None and q.sql else "run" if err is None else "BAD"
        print(f"{mark} {name:26s} rows={n:7d} {time.time() - t:6.2f}s {err or ''}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    main(sys.argv[1:])
