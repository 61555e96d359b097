"""Run registered queries in Spark and their DuckDB oracles; compare exactly.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Prints one line per query and exits non-zero on any mismatch.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda t: tuple("" if x is None else str(x) for x in t))


_SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT",
                  "string": "VARCHAR", "boolean": "BOOLEAN", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def type_mismatches(df, res) -> list[str]:
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = []
    for name, dtype in zip([d[0] for d in res.description], res.types if hasattr(res, "types") else []):
        want = _SPARK_TO_DUCK.get(spark_types.get(name, ""), spark_types.get(name, ""))
        if str(dtype) != want:
            out.append(f"{name}: spark {spark_types.get(name)} duck {dtype}")
    return out


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, name, fn, sql, sf_dir, con):
    t0 = time.time()
    df = fn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    scols, sdata = rows_of(df.columns, srows)
    if sql is None:
        return f"{name:24s} rows-only {len(srows):7d} rows  spark {t1 - t0:6.2f}s", True
    rel = con.sql(sql)
    tm = type_mismatches(df, rel)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    dcols, ddata = rows_of(dcols, drows)
    ok = scols == dcols and sdata == ddata
    msg = f"{name:24s} {'OK ' if ok else 'BAD'} spark {len(srows):7d} duck {len(drows):7d}  spark {t1 - t0:6.2f}s"
    if tm:
        msg += "  types: " + "; ".join(tm)
    if not ok:
        if scols != dcols:
            msg += f"\n   cols spark={scols}\n        duck ={dcols}"
        else:
            diff = [(a, b) for a, b in zip(sdata, ddata) if a != b][:3]
            msg += f"\n   first diffs: {diff}"
    return msg, ok


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from samplecraft.session import local_session
    import __spark_entry__ as entry
    spark = local_session(8, 8)
    for kv in filter(None, os.environ.get("ORACLE_SPARK_CONF", "").split(",")):  # e.g. spark.sql.ansi.enabled=false
        k, v = kv.split("=", 1)
        spark.conf.set(k, v)
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        try:
            msg, ok = compare(spark, name, qs[name], sqls.get(name), sf_dir, con)
        except Exception as e:  # report and continue
            msg, ok = f"{name:24s} ERROR {type(e).__name__}: {str(e)[:400]}", False
        bad += not ok
        print(msg, flush=True)
    print(f"mismatches: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
