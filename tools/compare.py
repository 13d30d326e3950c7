"""Run registered queries against their SQL in DuckDB: python tools/compare.py SF_DIR [name ...]."""
import math
import os
import signal
import sys
import threading
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from answerloom.plans import ORACLES, QUERIES  # noqa: E402
from answerloom.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, int):
        return (2, str(v))
    if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
        return (2, str(int(v)))
    if isinstance(v, float):
        f = float(v)
        return (2, "nan" if math.isnan(f) else f"{f:.6g}")
    return (3, str(v))


def compare(spark, con, name, sf_dir):
    """Returns (ok, message)."""
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    if name not in ORACLES:
        return True, f"rows-only {len(got)}"
    rel = con.sql(ORACLES[name])
    if sorted(rel.columns) != cols:
        return False, f"columns {cols} vs {sorted(rel.columns)}"
    order = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in order) for r in rel.fetchall())
    if got == want:
        return True, f"{len(got)} rows"
    a, b = set(got), set(want)
    return False, f"{len(got)} vs {len(want)} rows; spark-only {list(a - b)[:2]}; sql-only {list(b - a)[:2]} cols {cols}"


if __name__ == "__main__":
    sf = sys.argv[1]
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    con = connect(sf)
    bad = 0

    def late(*_):
        raise TimeoutError("query took over 60 s")

    signal.signal(signal.SIGALRM, late)
    for n in names:
        t = time.time()
        guard = threading.Timer(40, con.interrupt)
        guard.start()
        signal.alarm(60)
        try:
            ok, msg = compare(spark, con, n, sf)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:1500]}"
        signal.alarm(0)
        guard.cancel()
        bad += not ok
        print("ok  " if ok else "FAIL", n, f"{time.time() - t:.1f}s", msg, flush=True)
    print("failures:", bad)
