"""Command line: python -m aisleforge audit|brands|enhance|compare|query ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import plans, sinks
from .config import Config

#: Which queries make up each report.
REPORTS = {
    "audit": ("audit_records", "audit_category_summary", "audit_kpis", "audit_issues", "category_role"),
    "brands": ("brand_type_summary", "brand_rollup", "type_rollup", "majority_brand"),
    "enhance": ("brand_product_counts", "brand_statistics", "origin_summary", "zone_assign", "private_brands"),
    "compare": ("portfolio_kpis", "portfolio_ratios", "brand_hhi_store", "variety_index", "assortment_depth", "brand_overlap", "category_overlap", "market_share"),
}


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="aisleforge")
    parser.add_argument("report", choices=[*REPORTS, "query"])
    parser.add_argument("--input", required=True, help="folder of the Parquet tables")
    parser.add_argument("--output", help="folder for the sheets; without it rows are shown")
    parser.add_argument("--name", help="with query: which one")
    parser.add_argument("--store", help="keeps one supermarket's rows where a sheet has that column")
    parser.add_argument("--limit", type=int, help="shows so many rows")
    parser.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    parser.add_argument("--config-check", action="store_true", help="only validates the configuration")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("aisleforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    Config.of(spark)
    if given.config_check:
        print("configuration is valid")
        return 0
    names = [given.name] if given.report == "query" else REPORTS[given.report]
    sheets = {}
    for name in names:
        sheet = plans.QUERIES[name](spark, given.input)
        sheets[name] = sheet.filter(sheet["supermarket"] == given.store) if given.store and "supermarket" in sheet.columns else sheet
    if given.output:
        for name, path in sinks.workbook(sheets, given.output, given.format, skip_empty=("audit_issues",)).items():
            print(f"{name}: {path}")
    else:
        for name, sheet in sheets.items():
            print(name)
            sheet.show(given.limit or 20, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
