"""Cells and columns of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.structure import written

#: Rounds of vertical_merges() between two that deal the tables anew, and cells that a task works on at a time, as about so many, or one longer table.
STEPS, PART = 4, 1 << 19


def grid_columns(cells: DataFrame, table: str, order: str, span: str) -> DataFrame:
    """cells with grid_column: the columns that the cells before in the row take, from 0."""
    w = Window.partitionBy(table).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cells.withColumn("grid_column", F.sum(span).over(w) - F.col(span))


def widths(cells: DataFrame, table: str, span: str) -> DataFrame:
    return cells.groupBy(table).agg(F.sum(span).alias("width"), F.count("*").alias("cells"))


def vertical_merges(cells: DataFrame, by: str, row: str, place: str, colspan: str, rowspan: str) -> DataFrame:
    """cells with col, width and merge: the grid column at which each begins, the columns it takes, and start, continue or none.

    A cell over several rows takes the next cells that begin at its column, one a row, as placeholders of its own width; rows
    in which none begins there are not counted. Where cells begin depends on the rows above, so that columns and placeholders
    are worked out in rounds until nothing changes. What is right stays right, and each round makes the first wrong row of a
    table right: there are at most as many rounds as rows, in practice a few. Tables are dealt once for every STEPS rounds,
    and go on only while the last of these changed something in them.
    """
    none = lambda c, least: F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(least))
    rest = [c for c in cells.columns if c not in ("col", "width", "merge")]
    own = none(colspan, 1).cast("long")
    in_row = Window.partitionBy(by, row).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    in_col = Window.partitionBy(by, "new_col").orderBy(row)
    above = in_col.rowsBetween(Window.unboundedPreceding, -1)

    def step(now: DataFrame) -> DataFrame:
        new = now.withColumn("new_col", F.coalesce(F.sum("width").over(in_row), F.lit(0))).withColumn("n", F.row_number().over(in_col))
        until = F.max(F.when(~F.col("taken"), F.col("n") + none(rowspan, 1) - 1)).over(above)
        owner = F.last(F.when(~F.col("taken"), own), ignorenulls=True).over(above)
        new = new.withColumn("new_taken", F.coalesce(until >= F.col("n"), F.lit(False)))
        new = new.withColumn("new_width", F.when(F.col("new_taken"), owner).otherwise(own))
        same = (F.col("new_col") == F.col("col")) & (F.col("new_taken") == F.col("taken")) & (F.col("new_width") == F.col("width"))
        return new.select(*rest, (~same).alias("changed"), F.col("new_col").alias("col"), F.col("new_width").alias("width"), F.col("new_taken").alias("taken"))

    now = cells.select(*rest).withColumn("width", own).withColumn("taken", F.lit(False)).withColumn("col", F.lit(-1).cast("long"))
    left, done = now.count(), None
    while done is None or left:
        now = now.repartition(max(cells.sparkSession.sparkContext.defaultParallelism, left // PART + 1), by)
        for _ in range(STEPS):
            now = step(now)
        now = written(now.withColumn("changed", F.max("changed").over(Window.partitionBy(by))))
        ready = now.where("NOT changed")
        done = ready if done is None else done.unionByName(ready)
        now = now.where("changed").drop("changed")
        left = now.count()
    merge = F.when(F.col("taken"), "continue").when(none(rowspan, 1) > 1, "start").otherwise("none")
    return done.withColumn("merge", merge).drop("changed", "taken")
