"""Trees as intervals: what encloses a place, what a node holds, and what it inherits, by windows over starts and stops.

Spans are half-open, [start, stop), and nest: two of a group either have no place in common or one holds the other. Then
the number of open spans tells the innermost one: it is the last that opened at that number. No span is ever joined to all
that it holds, so that work grows with the places and spans, not with their depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STOP, _START, _POINT = 0, 1, 2
#: Points and ends of spans that a task works on at a time, as about so many, or those of one group.
PART = 1 << 19


def innermost(points: DataFrame, spans: DataFrame, by: str, at: str, start: str, stop: str, values: list[str]) -> DataFrame:
    """points with the values (columns of spans) of the innermost span around each, null outside all.

    A point at a span's start is inside, one at its stop is not. Of spans with the same start the one that stops later
    lies outside; of spans that are equal, the one with the smaller values. Spans that stop nowhere are given a stop.
    Both sides are counted and then dealt by group over as many partitions as they ask for, so they should be cheap to read.
    """
    value = F.struct(*values)
    none = F.lit(None).cast(spans.select(value.alias("v")).schema["v"].dataType)
    point = F.struct(*(c for c in points.columns if c != by))
    no_point = F.lit(None).cast(points.select(point.alias("p")).schema["p"].dataType)
    rows = spans.select(by, F.col(start).cast("long").alias("_at"), F.lit(_START).alias("_kind"), (-F.col(stop)).cast("long").alias("_rank"), value.alias("_value"), no_point.alias("_point"))
    rows = rows.unionByName(spans.select(by, F.col(stop).cast("long").alias("_at"), F.lit(_STOP).alias("_kind"), F.lit(0).cast("long").alias("_rank"), none.alias("_value"), no_point.alias("_point")))
    rows = rows.unionByName(points.select(by, F.col(at).cast("long").alias("_at"), F.lit(_POINT).alias("_kind"), F.lit(0).cast("long").alias("_rank"), none.alias("_value"), point.alias("_point")))
    size = points.count() + 2 * spans.count()
    rows = rows.repartition(max(points.sparkSession.sparkContext.defaultParallelism, size // PART + 1), by)
    order = ["_at", "_kind", "_rank", "_value"]
    step = F.when(F.col("_kind") == _START, 1).when(F.col("_kind") == _STOP, -1).otherwise(0)
    rows = rows.withColumn("_open", F.sum(step).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    of_number = Window.partitionBy(by, "_open").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_kind") == _START, F.col("_value")), ignorenulls=True).over(of_number)
    inside = rows.withColumn("_value", F.when(F.col("_open") > 0, last)).where(F.col("_kind") == _POINT)
    return inside.select(by, "_point.*", "_value.*")


def held(spans: DataFrame, points: DataFrame, by: str, at: str, start: str, stop: str, **what: Column) -> DataFrame:
    """spans with, for each name, how many points inside meet a condition (a column of points): differences of running counts.

    Spans need not nest here.
    """
    counts = {n: c.cast("long") for n, c in what.items()}
    rows = points.select(by, F.col(at).cast("long").alias("_at"), F.lit(1).alias("_kind"), *(F.coalesce(c, F.lit(0)).alias(n) for n, c in counts.items()))
    zero = [F.lit(0).cast("long").alias(n) for n in counts]
    ends = spans.select(by, F.explode(F.array(start, stop)).alias("_at")).distinct().select(by, F.col("_at").cast("long").alias("_at"), F.lit(0).alias("_kind"), *zero)
    so_far = Window.partitionBy(by).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    sums = ends.unionByName(rows).select(by, "_at", "_kind", *(F.sum(n).over(so_far).alias(n) for n in counts)).where("_kind = 0")
    side = lambda place, mark: sums.select(F.col(by).alias(f"_by{mark}"), F.col("_at").alias(f"_at{mark}"), *(F.col(n).alias(f"_{n}{mark}") for n in counts))
    out = spans
    for place, mark in ((start, "a"), (stop, "b")):
        out = out.join(side(place, mark), (F.col(by) == F.col(f"_by{mark}")) & (F.col(place) == F.col(f"_at{mark}")))
    return out.select(*spans.columns, *((F.col(f"_{n}b") - F.col(f"_{n}a")).alias(n) for n in counts))


def nodes(groups: DataFrame) -> DataFrame:
    """groups (path, open, close, depth, parent) as nodes: path, pre (from 0, a parent before its children), post (children before their parent), open, close, depth, parent, of those that close."""
    closed = groups.where("close IS NOT NULL")
    pre = F.row_number().over(Window.partitionBy("path").orderBy("open")) - 1
    post = F.row_number().over(Window.partitionBy("path").orderBy("close")) - 1
    return closed.select("path", pre.alias("pre"), post.alias("post"), "open", "close", "depth", "parent")
