"""Run registered queries against their SQL statements on DuckDB and compare the results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


TIMES: dict[str, float] = {}


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "tolist") and not isinstance(v, str):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in data]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    """None when equal, else a description of the first difference."""
    t = time.time()
    df = fn(spark, sf_dir)
    sn, sr = rows(df.columns, [tuple(r) for r in df.collect()])
    TIMES[name] = time.time() - t
    rel = con.sql(sql)
    on, orr = rows(rel.columns, rel.fetchall())
    if sn != on:
        return f"columns {sn} != {on}"
    if len(sr) != len(orr):
        return f"rows {len(sr)} != {len(orr)}"
    for a, b in zip(sr, orr):
        if a != b and not all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) <= 1e-6 * max(1, abs(x)))
                              or (isinstance(y, float) and isinstance(x, int) and x == y) for x, y in zip(a, b)):
            return f"spark {dict(zip(sn, a))}\n   duck {dict(zip(on, b))}"
    return None


def main(argv):
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from specmill.plans import registry
    from specmill.session import get_spark

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    only = argv[1:]
    if only and only[0].startswith("+"):
        import importlib

        for m in only[0][1:].split(","):
            importlib.import_module(f"specmill.plans.{m}")
        only = only[1:]
    else:
        registry.load()
    spark = get_spark("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name, fn in registry.QUERIES.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t = time.time()
        try:
            if name in registry.ORACLE:
                diff = compare(spark, con, name, fn, registry.ORACLE[name], sf)
            else:
                diff = None
                print("rows-only", name, fn(spark, sf).count())
        except Exception as e:  # noqa: BLE001
            diff = "ERROR " + str(e)[:1500]
        took = time.time() - t
        if diff:
            bad += 1
            print(f"BAD {name} ({took:.1f}s): {diff}", flush=True)
        else:
            print(f"ok {name} ({took:.1f}s, spark {TIMES.get(name, took):.1f}s)", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
