"""Reconciliation of edited documents: how the blocks of two versions line up, and comments to carry over."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.structure import written


def signature(kind: Column, text: Column) -> Column:
    """What makes two blocks the same: kind, and text but for white space."""
    return F.sha2(F.concat_ws("\n", kind, F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))), 256)


def _longest(pairs: pd.DataFrame) -> pd.DataFrame:
    """Of pairs (i, j), each side once, a longest chain in which both grow."""
    pairs = pairs.sort_values("i")
    ends, at, before = [], [], []
    for n, j in enumerate(pairs["j"]):
        k = bisect_left(ends, j)
        before.append(at[k - 1] if k else -1)
        ends[k:], at[k:] = [j, *ends[k + 1 :]], [n, *at[k + 1 :]]
    chain, n = [], at[-1] if at else -1
    while n >= 0:
        chain.append(n)
        n = before[n]
    return pairs.iloc[chain[::-1]]


def _chained(anchors: DataFrame) -> DataFrame:
    """Of anchors (key, seg, i, j) a longest chain of each segment.

    An anchor that crosses none is in every longest chain and parts those before it from those after: only what lies
    between two such anchors and crosses is looked at together, as numbers.
    """
    w = Window.partitionBy("key", "seg").orderBy("i")
    before, after = F.max("j").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.min("j").over(w.rowsBetween(1, Window.unboundedFollowing))
    alone = F.coalesce(before < F.col("j"), F.lit(True)) & F.coalesce(after > F.col("j"), F.lit(True))
    marked = anchors.withColumn("alone", alone).withColumn("stretch", F.sum(F.col("alone").cast("int")).over(w))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema)
    crossing = marked.where("NOT alone").groupBy("key", "seg", "stretch").applyInPandas(lambda pairs: _longest(pairs)[["key", "seg", "i", "j"]], kinds)
    return marked.where("alone").select("key", "seg", "i", "j").unionByName(crossing)


def _matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, i, j of the equal rows of both sides (key, seg, i or j, same) at the ends of each segment, and of a chain of anchors between them."""
    ends = None
    for down in (False, True):
        place = lambda side, x: F.row_number().over(Window.partitionBy("key", "seg").orderBy(F.desc(x) if down else x))
        both = a.withColumn("k", place(a, "i")).join(b.withColumn("k", place(b, "j")).withColumnRenamed("same", "other"), ["key", "seg", "k"])
        equal = F.min((F.col("same") == F.col("other")).cast("int")).over(Window.partitionBy("key", "seg").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
        both = both.withColumn("equal", equal).where("equal = 1").select("key", "seg", "i", "j", F.lit(down).alias("down"))
        ends = both if ends is None else ends.unionByName(both)
    # an end that runs into the other gives way to it
    first = ends.where("NOT down").groupBy("key", "seg").agg(F.max("i").alias("i0"), F.max("j").alias("j0"))
    ends = ends.join(first, ["key", "seg"], "left").where("NOT down OR i0 IS NULL OR (i > i0 AND j > j0)")
    ends = written(ends.select("key", "seg", "i", "j"))
    sides = [side.join(ends.select("key", "seg", x), ["key", "seg", x], "left_anti") for side, x in ((a, "i"), (b, "j"))]
    alone = [side.groupBy("key", "seg", "same").agg(F.min(x).alias(x), F.count("*").alias("n")).where("n = 1").drop("n") for side, x in zip(sides, "ij")]
    chain = _chained(alone[0].join(alone[1], ["key", "seg", "same"]).select("key", "seg", "i", "j"))
    return ends.unionByName(chain).select("key", "i", "j")


def aligned(old: DataFrame, new: DataFrame, by: str, order: str, same: str) -> DataFrame:
    """by and the steps that turn the old version of each document into the new one: step, tag (equal, replace, delete or
    insert), old_from, old_to, new_from, new_to. Places count from 0 in the given order, equal places by same.

    In rounds, for all documents at once: a segment's equal ends match; between them, rows whose value occurs once on both
    sides of the segment are anchors, of which a longest chain in order matches; what lies between matches is a segment of
    the next round. Rounds end when none finds a match. So no two rows are ever compared but by a join on their value, and
    rows that repeat on both sides match only from the ends. Null values are equal to each other; a null key has no rows.
    A document that only one side has is all deleted or all inserted.
    """
    value = F.coalesce(F.col(same).cast("string"), F.lit(""))
    number = lambda df, x: df.where(F.col(by).isNotNull()).select(F.col(by).alias("key"), F.lit(0).cast("long").alias("seg"), (F.row_number().over(Window.partitionBy(by).orderBy(order, same)) - 1).alias(x), value.alias("text"))
    a, b = (written(number(df, x)) for df, x in ((old, "i"), (new, "j")))
    # values as numbers, so that no text travels with the rounds
    ids = a.select("key", "text").unionByName(b.select("key", "text")).distinct()
    ids = written(ids.withColumn("same", F.monotonically_increasing_id()))
    sides = [written(side.join(ids, ["key", "text"]).select("key", "seg", x, "same")) for side, x in ((a, "i"), (b, "j"))]
    rest, found = sides, None
    while True:
        more = written(_matches(*rest))
        if more.isEmpty():
            break
        found = more if found is None else written(found.unionByName(more))
        cut = []
        for side, x in zip(rest, "ij"):
            marks = found.select("key", F.col(x).alias("at"), F.lit(1).alias("mark"))
            w = Window.partitionBy("key").orderBy("at", "mark").rowsBetween(Window.unboundedPreceding, 0)
            left = side.join(found.select("key", x), ["key", x], "left_anti").select("key", F.col(x).alias("at"), F.lit(0).alias("mark"), "same")
            both = left.unionByName(marks, allowMissingColumns=True).withColumn("seg", F.sum("mark").over(w).cast("long"))
            cut.append(written(both.where("mark = 0").select("key", "seg", F.col("at").alias(x), "same")))
        rest = cut
    sizes = sides[0].groupBy("key").agg(F.count("*").alias("n")).join(sides[1].groupBy("key").agg(F.count("*").alias("m")), "key", "full")
    sizes = sizes.select("key", F.coalesce("n", F.lit(0)).cast("int").alias("i"), F.coalesce("m", F.lit(0)).cast("int").alias("j"))
    return _steps(sizes if found is None else found.select("key", F.col("i").cast("int"), F.col("j").cast("int")).unionByName(sizes)).withColumnRenamed("key", by)


def _steps(matches: DataFrame) -> DataFrame:
    """Steps from the matches of each key and its end (the sizes of both versions): runs of matches side by side, and the gaps between them."""
    w = Window.partitionBy("key").orderBy("i", "j")
    rows = matches.withColumn("pi", F.coalesce(F.lag("i").over(w), F.lit(-1))).withColumn("pj", F.coalesce(F.lag("j").over(w), F.lit(-1))).withColumn("end", F.lead("i").over(w).isNull())
    gap = (F.col("i") > F.col("pi") + 1) | (F.col("j") > F.col("pj") + 1)
    rows = rows.withColumn("gap", gap).withColumn("run", F.sum(gap.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tag = F.when(F.col("i") == F.col("pi") + 1, "insert").when(F.col("j") == F.col("pj") + 1, "delete").otherwise("replace")
    gaps = rows.where("gap").select("key", tag.alias("tag"), (F.col("pi") + 1).alias("old_from"), F.col("i").alias("old_to"), (F.col("pj") + 1).alias("new_from"), F.col("j").alias("new_to"))
    runs = rows.where("NOT end").groupBy("key", "run").agg(F.min("i").alias("old_from"), (F.max("i") + 1).alias("old_to"), F.min("j").alias("new_from"), (F.max("j") + 1).alias("new_to"))
    steps = gaps.unionByName(runs.select("key", F.lit("equal").alias("tag"), "old_from", "old_to", "new_from", "new_to"))
    return steps.select("key", (F.row_number().over(Window.partitionBy("key").orderBy("old_from", "new_from")) - 1).alias("step"), "tag", "old_from", "old_to", "new_from", "new_to")


def grafted(kept: DataFrame, edited: DataFrame, by: str, text: str) -> DataFrame:
    """edited comments, and those of kept whose text their document doesn't have yet."""
    return edited.unionByName(kept.join(edited.select(by, text).distinct(), [by, text], "left_anti").select(edited.columns))
