"""Orders and labels of cited keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.typeset import letters


def first_seen(cites: DataFrame, doc: str, key: str, pos: str) -> DataFrame:
    """doc, key, number: distinct keys of each document, numbered in the order of their first citation."""
    first = cites.groupBy(doc, key).agg(F.min(pos).alias("first_pos"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(doc).orderBy("first_pos", key)))


def rendered(cites: DataFrame, doc: str, key: str, pos: str) -> DataFrame:
    """doc, label: the numbers of a document's citations in brackets, rising."""
    numbers = first_seen(cites, doc, key, pos).groupBy(doc).agg(F.sort_array(F.collect_list("number")).alias("n"))
    return numbers.select(doc, F.concat(F.lit("["), F.array_join(F.transform("n", lambda x: x.cast("string")), ", "), F.lit("]")).alias("label"))


def year_letters(items: DataFrame, author: str, year: str, order: str) -> DataFrame:
    """items with letter: a, b, c for items of one author and year, aa, ab and so on after z, none for the only one."""
    w = Window.partitionBy(author, year)
    return items.withColumn("letter", F.when(F.count("*").over(w) > 1, letters(F.row_number().over(w.orderBy(order)))).otherwise(""))


def bibliography_order(entries: DataFrame, by: list, numeric: bool) -> DataFrame:
    """entries (key, given, cited, author, year) with number, their place in the bibliography of their document: as given
    if any entry has a given place (those without come last), else as cited, or by author and year."""
    given = F.max(F.col("given").isNotNull()).over(Window.partitionBy(*by))
    own = [F.lit("")] * 2 if numeric else [F.lower("author"), F.col("year")]
    keys = [F.when(given, F.coalesce("given", F.lit(1 << 30))), *(F.when(~given, k) for k in own), F.col("cited"), F.col("key")]
    return entries.withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy(*keys)))


def cite_strings(cites: DataFrame, items: DataFrame, by: list, order: str) -> DataFrame:
    """A string for each citation (by): the labels of its keys in order, the key itself where items (key, label) has none."""
    found = cites.join(items.select("key", "label"), "key", "left").withColumn("shown", F.coalesce("label", F.col("key").cast("string")))
    parts = found.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, "shown"))).alias("parts"))
    return parts.select(*by, F.concat(F.lit("["), F.array_join(F.transform("parts", lambda p: p["shown"]), ", "), F.lit("]")).alias("cited"))
