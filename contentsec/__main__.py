"""python -m contentsec (or spark-submit): scan-pages, scan-text, scan-docs, check-outbound, report.

Each takes an input path (Parquet, or files for scan-docs) and an output path.
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from contentsec.operators import exfiltration, trust
from contentsec.plans import scan
from contentsec.session import session
from contentsec.sources import files


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="contentsec", description=__doc__)
    parser.add_argument("command", choices=("scan-pages", "scan-text", "scan-docs", "check-outbound", "report"))
    parser.add_argument("input")
    parser.add_argument("output")
    a = parser.parse_args(args)
    spark = session()
    if a.command == "scan-docs":
        files.write_reports(scan.scan_documents(files.binary_files(spark, a.input)).drop("data"), a.output)
    elif a.command == "scan-pages":
        files.write_reports(scan.scan_pages(spark.read.parquet(a.input)), a.output)
    elif a.command == "scan-text":
        files.write_reports(scan.scan_text(spark.read.parquet(a.input)), a.output)
    elif a.command == "check-outbound":
        files.write_json(exfiltration.check(spark.read.parquet(a.input)), a.output)
    else:
        rows = spark.read.parquet(a.input)
        rows = rows if "content_id" in rows.columns else rows.withColumn("content_id", F.monotonically_increasing_id())
        files.write_json(trust.summary(rows), a.output)


if __name__ == "__main__":
    main()
