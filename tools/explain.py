"""Print the plan of a catalogue query.

    python tools/explain.py funnel_mart [--sf /root/testdata/sf0.01] [--no-broadcast] [--summary]

``--no-broadcast`` turns broadcast joins and AQE off, which shows the exchanges the
plan has when every side is large (the at-scale shape); ``--summary`` prints only the
joins, exchanges, windows and aggregates with their keys.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("query")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--no-broadcast", action="store_true")
    ap.add_argument("--summary", action="store_true")
    a = ap.parse_args()

    from funnelkit.plans.catalog import QUERIES
    from funnelkit.session import build_session

    extra = {"spark.sql.debug.maxToStringFields": "1000"}
    if a.no_broadcast:
        extra.update({"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"})
    spark = build_session("local[4]", shuffle_partitions=8, extra=extra)
    df = QUERIES[a.query](spark, a.sf)
    if not a.summary:
        df.explain("formatted")
        return
    plan = df._jdf.queryExecution().executedPlan().toString()
    keep = re.compile(r"(Exchange|Join|Window|Aggregate|Union|Scan parquet)")
    for line in plan.splitlines():
        if keep.search(line):
            print(re.sub(r"#\d+L?", "", line)[:200])


if __name__ == "__main__":
    main()
