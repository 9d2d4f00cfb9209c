"""Commands: list and run queries, export segments.

    python -m talaan list
    python -m talaan run QUERY --data DIR --out FOLDER
    python -m talaan export SEGMENT --data DIR --out FILE.csv|FILE.xlsx
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from talaan.functions import score
from talaan.plans import catalog, leads
from talaan.sinks import files


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="talaan")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    for name, what in (("run", "query"), ("export", "segment")):
        c = sub.add_parser(name)
        c.add_argument(what)
        c.add_argument("--data", required=True)
        c.add_argument("--out", required=True)
    a = p.parse_args(argv)
    if a.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return 0
    known = catalog.queries() if a.command == "run" else score.segments
    if a.command == "run" and a.query not in known:
        print(f"unknown query {a.query}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("talaan").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "run":
        known[a.query](spark, a.data).write.mode("overwrite").parquet(a.out)
        return 0
    segments = score.segments()
    if a.segment not in segments:
        print(f"unknown segment; there are {', '.join(segments)}", file=sys.stderr)
        return 2
    rows = leads.scored(spark, a.data).where(segments[a.segment]).select("lead_id", "business_name", "phone", "email", "website", "address", "city", "score")
    write = files.write_xlsx if a.out.endswith(".xlsx") else files.write_csv
    write(rows, a.out, [("Segment", a.segment), ("Leads", str(rows.count()))])
    return 0


if __name__ == "__main__":
    sys.exit(main())
