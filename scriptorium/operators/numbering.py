"""Counters and running state as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def counter(rows: DataFrame, by: list[str], order: list[str], name: str = "number") -> DataFrame:
    """A running count in each group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def reset_counter(rows: DataFrame, by: list[str], order: list[str], section: Column, item: Column) -> DataFrame:
    """rows with section_number, and number: a count of items that begins anew at each section."""
    w = running(Window.partitionBy(*by).orderBy(*order))
    rows = rows.withColumn("section_number", F.sum(section.cast("int")).over(w))
    inner = running(Window.partitionBy(*by, "section_number").orderBy(*order))
    return rows.withColumn("number", F.when(item, F.sum(item.cast("int")).over(inner)))


def last_seen(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the latest non-null value so far."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(running(Window.partitionBy(*by).orderBy(*order))))


def runs(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """by, value, run, first, length: stretches of equal neighbours; first is the first order column's."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.row_number().over(w).eqNullSafe(1)).cast("int")
    marked = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(running(w)))
    return marked.groupBy(*by, "run").agg(F.first(value).alias(value), F.min(order[0]).alias("first"), F.count("*").alias("length"))


def queued(rows: DataFrame, by: list[str], order: list[str], is_mark: Column, is_text: Column, name: str) -> DataFrame:
    """by, mark, text: every text with the oldest mark before it that has none yet; a mark that gets none has a null text, a
    text that finds none a null mark. Marks leave the queue in the order in which they came, so that the k-th text which
    found any has the k-th mark."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("_step", F.when(is_mark, 1).when(is_text, -1)).where("_step IS NOT NULL")
    total = rows.withColumn("_sum", F.sum("_step").over(running(w)))
    waiting = F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(running(w)))
    total = total.withColumn("_waiting", waiting).withColumn("_found", (F.col("_step") == -1) & (F.coalesce(F.lag("_waiting").over(w), F.lit(0)) > 0))
    counts = total.withColumn("_k", F.when(F.col("_step") == 1, F.sum((F.col("_step") == 1).cast("int")).over(running(w))).when(F.col("_found"), F.sum(F.col("_found").cast("int")).over(running(w))))
    marks = counts.where("_step = 1").select(*by, "_k", F.col(name).alias("mark"))
    texts = counts.where("_step = -1").select(*by, "_k", F.col(name).alias("text"))
    return marks.join(texts, [*by, "_k"], "full").select(*by, "mark", "text")
