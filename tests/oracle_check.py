"""Local stand-in for the driver's correctness gate.

Runs every registered Spark query and its DuckDB oracle over the same parquet
tables and compares row count, column names and an order-insensitive multiset
of normalised rows.  Usage: ``python tests/oracle_check.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from feedsift.bind import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        return norm(v.item())
    return v


_DUCK = {"BIGINT": "long", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
         "DATE": "date", "TIMESTAMP": "timestamp", "FLOAT": "float", "SMALLINT": "short", "HUGEINT": "hugeint"}
_SPARK = {"LongType": "long", "IntegerType": "int", "DoubleType": "double", "StringType": "string",
          "BooleanType": "boolean", "DateType": "date", "TimestampNTZType": "timestamp", "TimestampType": "timestamp",
          "FloatType": "float", "ShortType": "short"}


def type_diff(df, description):
    spark_t = {f.name: _SPARK.get(type(f.dataType).__name__, type(f.dataType).__name__) for f in df.schema.fields}
    duck_t = {d[0]: _DUCK.get(str(d[1]), str(d[1])) for d in description}
    return {c: (spark_t[c], duck_t.get(c)) for c in spark_t if spark_t[c] != duck_t.get(c)}


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def check(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t1 = time.time()
    if sql is None:
        return {"name": name, "ok": None, "rows": len(srows), "spark_s": round(t1 - t0, 2)}
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    res = {"name": name, "rows": len(srows), "oracle_rows": len(drows), "spark_s": round(t1 - t0, 2)}
    if sorted(scols) != sorted(dcols):
        res.update(ok=False, why=f"columns {sorted(scols)} vs {sorted(dcols)}")
        return res
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    if a != b:
        diff = [x for x in a if x not in b][:3], [x for x in b if x not in a][:3]
        res.update(ok=False, why=f"values differ; spark-only {diff[0]} oracle-only {diff[1]}")
        return res
    res["ok"] = True
    td = type_diff(df, cur.description)
    if td:
        res["types"] = td
    return res


def main(argv):
    from feedsift.catalog import ORACLES, QUERIES, load_all
    from feedsift.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    load_all()
    spark = local_session(8)
    con = duck(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if names and name not in names:
            continue
        try:
            res = check(spark, con, name, fn, ORACLES.get(name), sf_dir)
        except Exception as e:  # report and go on
            res = {"name": name, "ok": False, "why": f"{type(e).__name__}: {str(e)[:400]}"}
        if res.get("ok") is False:
            bad += 1
        print(res, flush=True)
    print(f"FAILED {bad}" if bad else "ALL OK", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
