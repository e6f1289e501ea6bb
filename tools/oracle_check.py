"""Run catalogue queries in Spark and their oracle SQL in DuckDB; compare.

Comparison: column names, a Spark->DuckDB type mapping, row count, and the multiset
of rows (floats compared after rounding to 9 significant digits, and exactly).
Usage: python tools/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "boolean": "BOOLEAN", "smallint": "SMALLINT",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, approx: bool):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if approx:
            return float(f"{v:.9g}") + 0.0
        return repr(v)  # exact: keeps -0.0 apart from 0.0 and every digit
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item(), approx)
    return v


def _rows(records, cols, approx):
    out = [tuple(_norm(r[c], approx) for c in cols) for r in records]
    out.sort(key=lambda t: tuple((x is None, str(x)) for x in t))
    return out


def compare(spark, con, name, sf_dir, q, sql):
    t0 = time.time()
    sdf = q(spark, sf_dir)
    s_types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    s_recs = [r.asDict() for r in sdf.collect()]
    t1 = time.time()
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_recs = [dict(zip(d_cols, r)) for r in rel.fetchall()]
    d_types = dict(zip(d_cols, [str(t) for t in con.execute(f"DESCRIBE {sql}").fetchall() and
                                [x[1] for x in con.execute(f"DESCRIBE {sql}").fetchall()]]))
    res = {"query": name, "spark_rows": len(s_recs), "oracle_rows": len(d_recs), "spark_sec": round(t1 - t0, 2)}
    if sorted(s_types) != sorted(d_cols):
        res["status"] = f"COLUMNS differ: spark-only {sorted(set(s_types) - set(d_cols))} oracle-only {sorted(set(d_cols) - set(s_types))}"
        return res
    cols = sorted(s_types)
    type_diff = {c: (s_types[c], d_types.get(c)) for c in cols if SPARK_TO_DUCK.get(s_types[c]) != d_types.get(c)}
    exact = _rows(s_recs, cols, False) == _rows(d_recs, cols, False)
    approx = exact or _rows(s_recs, cols, True) == _rows(d_recs, cols, True)
    res["status"] = "OK" if exact else ("OK~" if approx else "MISMATCH")
    if type_diff:
        res["types"] = type_diff
    if not approx:
        a, b = _rows(s_recs, cols, True), _rows(d_recs, cols, True)
        sa, sb = set(a), set(b)
        res["example_spark_only"] = [dict(zip(cols, r)) for r in list(sa - sb)[:2]]
        res["example_oracle_only"] = [dict(zip(cols, r)) for r in list(sb - sa)[:2]]
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from funnelkit.plans.catalog import QUERIES
    from funnelkit.plans.oracle import ORACLE
    from funnelkit.session import build_session

    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    bad = 0
    for name in names or list(QUERIES):
        try:
            r = compare(spark, con, name, sf_dir, QUERIES[name], ORACLE[name])
        except Exception as e:  # report and continue
            r = {"query": name, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        bad += not str(r["status"]).startswith("OK")
        print(r, flush=True)
    print("FAILED", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
