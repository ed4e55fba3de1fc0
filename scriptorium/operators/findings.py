"""Findings against a baseline, margins of a matrix, copies and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(found: DataFrame, baseline: DataFrame, ran: DataFrame, key: str) -> DataFrame:
    """All columns of either, and status: new, fixed or known. Only what ran (its keys) can be fixed or known."""
    a, b = found.distinct().withColumn("_a", F.lit(True)), baseline.join(ran.select(key).distinct(), key, "left_semi").select(found.columns).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, found.columns, "full")
    status = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "fixed").otherwise("known")
    return both.select(*found.columns, status.alias("status"))


def margins(rows: DataFrame, x: str, y: str, failed: str) -> DataFrame:
    """x, y, n, failed: cells, margins and total of a matrix; null stands for all."""
    return rows.groupingSets([[x, y], [x], [y], []], x, y).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("failed"))


def first_copies(docs: DataFrame) -> DataFrame:
    """doc_id, media_id: equal texts share the smallest doc_id among them."""
    marked = docs.select("doc_id", F.md5(F.encode("text", "utf-8")).alias("digest"))
    return marked.join(marked.groupBy("digest").agg(F.min("doc_id").alias("media_id")), "digest").select("doc_id", "media_id")


def broken_lines(cells: DataFrame, failing: DataFrame, line: str, family: str, share: float = 0.6) -> DataFrame:
    """line, family, failing, cells: rows (or columns) of a matrix of which more than one cell, and at least share of all, fail the same way."""
    total = cells.groupBy(line).agg(F.count("*").alias("cells"))
    bad = failing.groupBy(line, family).agg(F.count("*").alias("failing")).where("failing > 1")
    return bad.join(total, line).where(F.col("failing") >= share * F.col("cells"))
