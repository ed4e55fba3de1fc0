"""Reports of a corpus as JSON rows and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entries_report(entries: DataFrame, by: str) -> DataFrame:
    """by, report: JSON of one document's counts by severity and by construct; entries: by, severity, construct."""
    counts = entries.groupBy(by, "severity", "construct").agg(F.count("*").alias("n"))
    rows = F.sort_array(F.collect_list(F.struct("construct", "severity", "n")))
    totals = counts.groupBy(by).agg(F.sum(F.when(F.col("severity") == "warning", F.col("n")).otherwise(0)).alias("warnings"), F.sum(F.when(F.col("severity") == "error", F.col("n")).otherwise(0)).alias("errors"), rows.alias("constructs"))
    return totals.select(by, F.to_json(F.struct("constructs", "errors", "warnings")).alias("report"))


def manifest(rows: DataFrame, by: str, order: str) -> DataFrame:
    """by, manifest: JSON of a document's rows in order, the fields of each sorted by name."""
    fields = F.struct(*sorted(c for c in rows.columns if c != by))
    listed = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_order"), fields.alias("row")))).alias("rows"))
    return listed.select(by, F.to_json(F.transform("rows", lambda r: r["row"])).alias("manifest"))
