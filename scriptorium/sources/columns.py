r"""Column specifications of tables as rows, repeated parts expanded.

A specification is read from the token table: its characters, the groups after them, and the group around them. A repeated
part, *{n}{...}, multiplies what stands in its second group; parts within parts are expanded from the inside out, one round
for each depth, in which a column's place gets the number of the repetition in front. What stands in other groups, or in
square brackets, is no column.

Cases: a null or empty specification has no columns; a count that is no number counts as one, one below zero as none; a
repeated part that never closes, or a p, m or b without a group, is no column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.markup import absolute_emu
from scriptorium.operators.structure import written
from scriptorium.sources import tokens

#: Columns and how they align; p, m and b have a width, D three arguments.
ALIGNED = {"l": "left", "c": "center", "r": "right", "X": "left", "L": "left", "C": "center", "R": "right", "J": "left", "S": "center", "D": "center", "p": "left", "m": "left", "b": "left"}
#: Commands before a column that align it.
PROCESSORS = {"raggedright": "left", "centering": "center", "raggedleft": "right"}
#: Items that a task works on at a time, as about so many, or those of one longer specification.
PART = 1 << 18


def _items(specs: DataFrame) -> DataFrame:
    """path, at, ch (a character of text, or the kind of another token), group, body_from, body_to, and run: the item before a row of groups, with arg, the place of a group in it."""
    rows = tokens.nested(tokens.tokens(specs)).where("kind <> '}'")
    text = F.when(F.col("kind") == "text", F.split("token", "")).otherwise(F.array(F.col("kind")))
    rows = rows.select("path", F.col("start").alias("first"), F.col("stop").alias("body_from"), F.col("partner_start").alias("body_to"), "group", "depth", F.col("pos").alias("brace"), F.length("token").alias("size"), "kind", F.posexplode(text).alias("n", "ch")).where("ch <> ''")
    # only the last character of a text may have groups; others that are no column say nothing
    rows = rows.where((F.col("kind") != "text") | F.col("ch").isin(list(ALIGNED)) | (F.col("n") == F.col("size") - 1)).drop("size", "kind")
    rows = rows.withColumn("at", F.col("first") + F.col("n"))
    w = Window.partitionBy("path", "depth", "group").orderBy("at")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    bracket = F.last(F.when(F.col("ch").isin("[", "]"), F.col("ch")), ignorenulls=True).over(before)
    rows = rows.withColumn("optional", F.coalesce(bracket == "[", F.lit(False)) | (F.col("ch") == "["))
    rows = rows.withColumn("run", F.sum((F.col("ch") != "{").cast("int")).over(w))
    in_run = Window.partitionBy("path", "depth", "group", "run").orderBy("at")
    rows = rows.withColumn("head", F.first(F.when(F.col("ch") != "{", F.col("ch"))).over(in_run)).withColumn("arg", F.row_number().over(in_run) - 1)
    return rows.withColumn("next", F.lead("ch").over(w)).withColumn("begun", F.first("at").over(in_run))


def columns(specs: DataFrame) -> DataFrame:
    """path, number (from 0), type, alignment, width (EMU, null without one) of every column of specs (path, source)."""
    items = written(_items(specs))
    parts = max(specs.sparkSession.sparkContext.defaultParallelism, items.count() // PART + 1)
    dealt = lambda df, *more: df.repartition(parts, "path", *more)
    bodies = tokens.texts_between(dealt(specs), dealt(items.where("ch = '{' AND body_to IS NOT NULL").select("path", "brace", "begun", "group", "depth", "head", "arg", "at", "optional", "body_from", "body_to")), body=("body_from", "body_to"))
    bodies = written(bodies)
    times = F.greatest(F.coalesce(F.trim("body").try_cast("int"), F.lit(1)), F.lit(0))
    stars = dealt(bodies.where("head = '*'"), "begun").withColumn("times", F.max(F.when(F.col("arg") == 1, times)).over(Window.partitionBy("path", "begun")))
    repeated = written(stars.where("arg = 2 AND NOT optional AND times IS NOT NULL").select("path", F.col("brace").alias("group"), F.col("group").alias("above"), "begun", "times"))

    align = F.lit(None).cast("string")
    for name, side in PROCESSORS.items():
        align = F.when(F.contains("body", F.lit("\\" + name)), side).otherwise(align)
    said = bodies.where("head = '>' AND arg = 1").select("path", "at", align.alias("said"))
    widths = bodies.where("head IN ('p', 'm', 'b') AND arg = 1").select("path", F.col("begun").alias("at"), absolute_emu(F.col("body")).alias("width"))
    is_column = ~F.col("optional") & F.col("ch").isin(list(ALIGNED)) & (~F.col("ch").isin("p", "m", "b", "D") | F.coalesce(F.col("next") == "{", F.lit(False)))
    # what bodies say, and the items that it is about, side by side: dealt by path once, all windows below need no other shuffle
    facts = said.unionByName(widths, allowMissingColumns=True)
    own = dealt(items.select("path", "depth", "group", "at", "ch", is_column.alias("column")).unionByName(facts, allowMissingColumns=True))
    here = Window.partitionBy("path", "at")
    own = own.withColumn("said", F.max("said").over(here)).withColumn("width", F.max("width").over(here)).where("column IS NOT NULL")
    w = Window.partitionBy("path", "depth", "group").orderBy("at")
    own = own.withColumn("segment", F.coalesce(F.sum(F.col("column").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pending = F.last("said", ignorenulls=True).over(Window.partitionBy("path", "depth", "group", "segment").orderBy("at"))
    usual = F.create_map(*(F.lit(x) for pair in ALIGNED.items() for x in pair))
    own = own.withColumn("alignment", F.coalesce(pending, usual[F.col("ch")])).where("column")

    done, now = None, written(own.select("path", "group", F.array(F.col("at").cast("long")).alias("place"), F.col("ch").alias("type"), "alignment", "width"))
    while not now.isEmpty():
        top = now.where("group IS NULL").drop("group")
        done = top if done is None else done.unionByName(top)
        inner = dealt(now, "group").join(dealt(repeated, "group"), ["path", "group"]).where("times > 0").withColumn("k", F.explode(F.sequence(F.lit(1), "times")))
        place = F.concat(F.array(F.col("begun").cast("long"), F.col("k").cast("long")), "place")
        now = written(inner.select("path", F.col("above").alias("group"), place.alias("place"), "type", "alignment", "width"))
    number = F.row_number().over(Window.partitionBy("path").orderBy("place")) - 1
    empty = now.drop("group") if done is None else done
    return dealt(empty).select("path", number.alias("number"), "type", "alignment", "width")
