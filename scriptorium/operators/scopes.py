"""Counters, labels, scopes, nesting, fields and sections: what rows in document order say about those after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _until(by: list, order: list):
    """All rows of a group up to and with the present one."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def user_counter(rows: DataFrame, by: list, order: list, restarts: Column, change: Column) -> DataFrame:
    """rows with counter: changes are summed from the last row that sets the counter or steps its parent; null changes are zero."""
    epochs = rows.withColumn("epoch", F.sum(F.coalesce(restarts, F.lit(False)).cast("int")).over(_until(by, order)))
    return epochs.withColumn("counter", F.sum(F.coalesce(change, F.lit(0))).over(_until([*by, "epoch"], order))).drop("epoch")


def label_targets(rows: DataFrame, by: list, order: list, is_label: Column, place: Column) -> DataFrame:
    """The labels among rows, with the place of the last row that can bear one (place is null for others), null if there
    is none, and whether an earlier label has it already, so that this is an alias."""
    seen = rows.withColumn("target", F.last(place, ignorenulls=True).over(_until(by, order))).where(is_label)
    turn = F.row_number().over(Window.partitionBy(*by, "target").orderBy(*order))
    return seen.withColumn("alias", F.col("target").isNotNull() & (turn > 1))


def in_force(rows: DataFrame, group: list, order: list, declared: Column, name: str) -> DataFrame:
    """rows with the declaration that holds for each: the last one in its group, null before the first."""
    return rows.withColumn(name, F.last(declared, ignorenulls=True).over(_until(group, order)))


def list_parents(rows: DataFrame, by: list, position: str, level: str, levels: int = 9) -> DataFrame:
    """rows with parent: the position of the last row before it with a smaller level (0 to levels - 1), null at the top."""
    before = Window.partitionBy(*by).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col(level) > k, F.max(F.when(F.col(level) == k, F.col(position))).over(before)) for k in range(levels - 1)]
    return rows.withColumn("parent", F.greatest(*last, F.lit(None).cast("long")))


def field_phases(rows: DataFrame, by: list, order: list, begins: Column, separates: Column, ends: Column) -> DataFrame:
    """rows with field, the number of the field begun last, and phase: instr from its begin, result from its separator, outside
    from its end; separators and ends outside a field do nothing, a begin in a field ends that field."""
    out = rows.withColumn("field", F.sum(F.coalesce(begins, F.lit(False)).cast("int")).over(_until(by, order)))
    seen = lambda what: F.coalesce(F.bool_or(what).over(_until([*by, "field"], order)), F.lit(False))
    phase = F.when((F.col("field") == 0) | seen(ends), "outside").when(seen(separates), "result").otherwise("instr")
    return out.withColumn("phase", phase)


def field_text(kind: Column, shown: Column, page: Column, number: Column, text: Column) -> Column:
    """What a field shows of its bookmark (page, number and text are null without one): a page, 1 if it is unknown; a number
    without full stops at its end, or a text without white space around it, where there is one; else what it showed."""
    return F.when(kind == "page", F.coalesce(page.cast("string"), F.lit("1"))).when(kind == "number", F.coalesce(F.rtrim(number, F.lit(".")), shown)).otherwise(F.coalesce(F.nullif(F.trim(text), F.lit("")), shown))


def indents(rows: DataFrame, by: list, order: list, change: Column) -> DataFrame:
    """rows with indent: the running sum of changes (1 opens, -1 closes), which a close at zero leaves at zero."""
    out = rows.withColumn("sum_", F.sum(change).over(_until(by, order)))
    return out.withColumn("indent", F.col("sum_") - F.least(F.lit(0), F.min("sum_").over(_until(by, order)))).drop("sum_")


def segments(rows: DataFrame, by: list, order: list, marker: Column) -> DataFrame:
    """The rows between markers, with segment, the number of markers before them."""
    return rows.withColumn("segment", F.sum(marker.cast("int")).over(_until(by, order))).where(~marker)


def long_table(rows: DataFrame, by: list, order: list, marker: Column) -> DataFrame:
    """The rows of long tables that are set once, with part: marker is firsthead, head, foot or lastfoot on the row that
    ends such a part, null elsewhere. The repeated head is kept, or the first head where there is none; feet go. Of
    several parts of a kind the last counts."""
    in_order = Window.partitionBy(*by).orderBy(*order)
    out = rows.withColumn("mark_", marker).withColumn("n_", F.row_number().over(in_order))
    ending = F.first(F.when(F.col("mark_").isNotNull(), F.struct(F.col("mark_").alias("part"), F.col("n_").alias("at"))), ignorenulls=True)
    out = out.withColumn("end_", ending.over(in_order.rowsBetween(0, Window.unboundedFollowing))).withColumn("part", F.coalesce("end_.part", F.lit("body")))
    last = lambda part: F.max(F.when(F.col("part") == part, F.col("end_.at"))).over(Window.partitionBy(*by))
    kept = out.withColumn("kept_", F.coalesce(last("head"), last("firsthead")))
    return kept.where("part = 'body' OR (part IN ('head', 'firsthead') AND end_.at = kept_)").drop("mark_", "n_", "end_", "kept_")


def cells_under_rule(rows: DataFrame, column: str, first: Column, last: Column) -> DataFrame:
    """rows with ruled: whether a partial rule from the first to the last column lies under the cell."""
    return rows.withColumn("ruled", F.coalesce(F.col(column).between(first, last), F.lit(False)))


def pending(rows: DataFrame, by: list, order: list, marker: Column, takes: Column) -> DataFrame:
    """The rows that take a marker, with the last one (null for other rows) since the row before that took one, or null."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.withColumn("run", F.coalesce(F.sum(takes.cast("int")).over(before), F.lit(0)))
    return runs.withColumn("marker", F.last(marker, ignorenulls=True).over(_until([*by, "run"], order))).where(takes).drop("run")


def listed_marks(rows: DataFrame, by: list, order: list, own: Column) -> DataFrame:
    """rows with mark: its own, else its number among the rows of one command if there are several, else none."""
    number, several = F.row_number().over(Window.partitionBy(*by).orderBy(*order)), F.count("*").over(Window.partitionBy(*by)) > 1
    return rows.withColumn("mark", F.coalesce(own, F.when(several, number.cast("string"))))
