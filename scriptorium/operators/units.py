"""Texts of units: names as rows, joined to their symbols and gathered into factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.markup import POWERS, POWERS_BEFORE, PREFIXES, THIN, UNITS


def symbols(spark) -> DataFrame:
    """name, kind (prefix, unit, power, before or per), symbol of every known name."""
    kinds = (("prefix", PREFIXES), ("unit", UNITS), ("power", POWERS), ("before", POWERS_BEFORE), ("per", {"per": "/"}))
    return spark.createDataFrame([(name, kind, symbol) for kind, table in kinds for name, symbol in table.items()], "name string, kind string, symbol string")


def unit_texts(rows: DataFrame, by: str, names: str) -> DataFrame:
    """by and text: the symbols of each row's list of names; rows are told apart by by.

    A factor is what ends with a unit and the power after it: "per", a power that stands before, prefixes and the unit. Its
    sign, a slash after "per" and else a thin space, comes first, then prefix and unit, then the power. A name that isn't
    known is text at the end of its factor. An empty list has an empty text.
    """
    parts = rows.select(by, F.posexplode_outer(names).alias("pos", "name")).join(F.broadcast(symbols(rows.sparkSession)), "name", "left")
    in_order = Window.partitionBy(by).orderBy("pos")
    before, kind = F.lag("kind").over(in_order), F.col("kind")
    opens = (F.col("pos") == 0) | (kind.isin("per", "before", "prefix", "unit") & ~F.coalesce(before.isin("per", "before", "prefix"), F.lit(False)))
    parts = parts.withColumn("factor", F.sum(F.coalesce(opens, F.lit(False)).cast("int")).over(in_order))
    place = F.when(kind == "per", 0).when(kind.isin("prefix", "unit"), 1).otherwise(2)
    text = F.when(F.col("pos").isNotNull() & (kind.isNull() | (kind != "per")), F.coalesce("symbol", "name"))
    factors = parts.groupBy(by, "factor").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "pos", F.coalesce(text, F.lit("")).alias("text")))).alias("p"), F.max(F.coalesce(kind == "per", F.lit(False))).alias("per"))
    sign = F.when(F.col("per"), "/").when(F.col("factor") > 1, THIN).otherwise("")
    factors = factors.select(by, "factor", F.concat(sign, F.array_join(F.transform("p", lambda x: x["text"]), "")).alias("text"))
    whole = factors.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("factor", "text"))).alias("f"))
    return whole.select(by, F.array_join(F.transform("f", lambda x: x["text"]), "").alias("text"))
