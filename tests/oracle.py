"""Run registered queries beside their SQL: python tests/oracle.py [sf dir] [name ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 9)) if v != int(v) or abs(v) > 1e15 else str(int(v))
    if hasattr(v, "quantize"):
        return str(int(v)) if v == v.to_integral_value() else str(float(v))
    return str(v)


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), sorted(names)


def connect(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def check(spark, con, sf, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf)
    got, cols = normal([tuple(r) for r in df.collect()], df.columns)
    took = time.time() - t0
    if sql is None:
        return "rows-only", f"{len(got)} rows", took
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want, wcols = normal(cur.fetchall(), names)
    if cols != wcols:
        return "COLUMNS", f"{cols} != {wcols}", took
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return "DIFF", f"{len(got)} vs {len(want)} rows; {cols}\n   spark {sorted(a)[:3]}\n   duck  {sorted(b)[:3]}", took
    odd = [f"{n}:{t}" for n, t in types.items() if t.startswith(("decimal", "map", "variant", "array", "struct", "timestamp"))]
    return "ok", f"{len(got)} rows {' '.join(odd)}", took


def main(argv):
    from tidemark.plans import ORACLES, QUERIES
    from tidemark.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con = local_session(8), connect(sf)
    bad = 0
    for name in names:
        try:
            state, note, took = check(spark, con, sf, name, QUERIES[name], ORACLES.get(name))
        except Exception as exc:  # noqa: BLE001 - report and go on
            state, note, took = "ERROR", str(exc)[:420], 0.0
        bad += state not in ("ok", "rows-only")
        print(f"{state:10s}{took:7.2f}s {name}: {note}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
