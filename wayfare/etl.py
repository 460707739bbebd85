"""Batch entry point: raw CSV files -> clean tables, dashboard copy, report, data checks.

    python -m wayfare.etl RAW_FOLDER OUT_FOLDER
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from wayfare.plans.report import write_checks, write_report
from wayfare.session import configure, size_shuffles
from wayfare.sources.raw import from_csv
from wayfare.sources.warehouse import Warehouse


def run(
    spark: SparkSession, raw_folder: str, out_folder: str, **options: bool
) -> Warehouse:
    """``options`` are those of ``Warehouse``."""
    configure(spark)
    raw = from_csv(spark, raw_folder)
    size_shuffles(spark, raw.scan_bytes())
    wh = Warehouse(spark, f"{out_folder}/tables", raw, **options).write_all()
    wh.write_slim(f"{out_folder}/dashboard")
    write_report(wh, f"{out_folder}/report")
    write_checks(wh, f"{out_folder}/checks")
    return wh


if __name__ == "__main__":
    run(SparkSession.builder.appName("wayfare").getOrCreate(), *sys.argv[1:3])
