"""Compare registered queries with their check SQL. Also a command line tool:
python tests/oracle.py [sf] [name-prefix ..]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from beliefmill.plans import registry  # noqa: E402
from beliefmill.plans.tables import RAW  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for r in RAW:
        con.execute(f"CREATE VIEW {r} AS SELECT * FROM '{sf_dir}/{r}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if v == 0 else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(cols, rows):
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in idx) for r in rows), key=repr)


def compare(spark, con, name, sf_dir):
    df = registry.QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.CHECKS:
        return len(got), None
    rel = con.execute(registry.CHECKS[name])
    cols = [d[0] for d in rel.description]
    want = rows_of(cols, rel.fetchall())
    if sorted(cols) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} != {sorted(cols)}"
    if got == want:
        return len(got), ""
    gs, ws = set(map(repr, got)), set(map(repr, want))
    return len(got), f"{len(got)} vs {len(want)} rows; only spark {sorted(gs - ws)[:3]}; only check {sorted(ws - gs)[:3]}"


def main(argv):
    from beliefmill.session import local_session

    sf = argv[0] if argv else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    mods = os.environ.get("MODULES")
    if mods:
        import importlib
        for m in mods.split():
            importlib.import_module(f"beliefmill.plans.{m}")
    else:
        registry.load_all()
    bad = 0
    for name in registry.QUERIES:
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        t0 = time.time()
        try:
            n, diff = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            n, diff = -1, "ERROR " + str(e)[:900]
        ok = diff in ("", None)
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} rows={n} {time.time() - t0:.1f}s {'(no check)' if diff is None else diff}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
