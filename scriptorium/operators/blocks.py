"""From texts to ordered rows of blocks and constructs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T

TAG = "<([a-z][a-z0-9]*)"


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, block: the lines that hold more than white space, in reading order."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    return lines.select(key, F.col("line").alias("pos"), T.normal_space(F.col("raw")).alias("block")).where("block <> ''")


def constructs(pages: DataFrame) -> DataFrame:
    """page_id, construct: every opening tag."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(TAG), 1)).alias("construct"))


def links(pages: DataFrame) -> DataFrame:
    """page_id, target, internal: every href."""
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target"))
    return found.withColumn("internal", F.startswith("target", F.lit("/")))


def coverage(pages: DataFrame) -> DataFrame:
    """Counts of constructs by page, and the share of its blocks that are paragraphs; 100 without blocks."""
    n = lambda tag: F.regexp_count("html", F.lit(f"<{tag}[ >]"))
    out = pages.select("page_id", n("p").alias("paragraphs"), n("h1").alias("headings"), n("li").alias("items"), n("a").alias("links"))
    out = out.withColumn("blocks", F.col("paragraphs") + F.col("headings") + F.col("items"))
    return out.withColumn("paragraph_share", F.when(F.col("blocks") == 0, 100.0).otherwise(F.round(100.0 * F.col("paragraphs") / F.col("blocks"), 4)))
