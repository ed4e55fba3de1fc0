"""Scopes, regions, tags and captions of ordered rows, and chains of aliases."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.operators.findings import broken_lines
from scriptorium.operators.numbering import running


def epoch(rows: DataFrame, by: list[str], order: list[str], starts: Column, name: str = "after") -> DataFrame:
    """rows with whether a start has been seen so far, itself included."""
    return rows.withColumn(name, F.coalesce(F.bool_or(starts).over(running(Window.partitionBy(*by).orderBy(*order))), F.lit(False)))


def pages(rows: DataFrame, by: list[str], order: list[str], breaks: Column, name: str = "page") -> DataFrame:
    """rows with 1 and the number of breaks so far."""
    return rows.withColumn(name, 1 + F.count_if(breaks).over(running(Window.partitionBy(*by).orderBy(*order))))


def tagged(rows: DataFrame, by: list[str], order: list[str], tag: Column, name: str = "number") -> DataFrame:
    """rows with their own tag, or else the number of rows without one so far: a tag takes no number."""
    count = F.count_if(tag.isNull()).over(running(Window.partitionBy(*by).orderBy(*order)))
    return rows.withColumn(name, F.coalesce(tag, count.cast("string")))


def before_first(rows: DataFrame, by: list[str], order: list[str], mark: Column) -> DataFrame:
    """Rows before the first mark of their group; none of groups without a mark."""
    w = Window.partitionBy(*by)
    at = F.row_number().over(w.orderBy(*order))
    rows = rows.withColumn("_at", at).withColumn("_mark", mark)
    return rows.withColumn("_first", F.min(F.when(F.col("_mark"), F.col("_at"))).over(w)).where("_at < _first").drop("_at", "_mark", "_first")


def enclosed(rows: DataFrame, by: list[str], order: list[str], opens: Column, closes: Column) -> DataFrame:
    """Rows between an opening row and the next closing one, with region (the number of the opening row); marks left out."""
    w = running(Window.partitionBy(*by).orderBy(*order))
    rows = rows.withColumn("_open", opens).withColumn("_close", closes).withColumn("region", F.count_if("_open").over(w))
    shut = F.count_if("_close").over(running(Window.partitionBy(*by, "region").orderBy(*order)))
    rows = rows.withColumn("_shut", shut)
    return rows.where("region > 0 AND _shut = 0 AND NOT _open").drop("_open", "_close", "_shut")


def captions(rows: DataFrame, by: list[str], order: str, kind: Column, caption: Column) -> DataFrame:
    """by, target, caption: order values of a captioned row and the caption that follows it at once."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = rows.withColumn("_target", F.lag(F.when(kind, F.col(order))).over(w))
    return rows.where(caption & F.col("_target").isNotNull()).select(*by, F.col("_target").alias("target"), F.col(order).alias("caption"))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in a local session without one, a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("scriptorium.scratch", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="scriptorium-")
        spark.conf.set("scriptorium.scratch", folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: unlike a checkpoint it is computed once, and what Spark knew of its columns, which
    may double with every round of a loop, ends here too."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chain_ends(links: DataFrame, key: str, kept: str) -> DataFrame:
    """key, kept: the end of the chain from each key, which has one link at most; null where the chain runs into a cycle.

    The stride doubles until every chain has ended; chains that go on for more links than there are run in cycles. Each
    round is a join, and its result is checkpointed, as the plan would double too.
    """
    ends, stride, most = links.select(key, kept), 1, None
    while True:
        on = ends.select(F.col(key).alias(kept), F.col(kept).alias("_next"))
        ends = ends.join(on, kept, "left")
        ends = ends.select(key, F.coalesce("_next", kept).alias(kept), F.col("_next").isNotNull().alias("_open"))
        ends = cut_lineage(ends)
        most = ends.count() if most is None else most
        if ends.where("_open").isEmpty():
            return ends.drop("_open")
        if stride > most:
            return ends.select(key, F.when(~F.col("_open"), F.col(kept)).alias(kept))
        ends, stride = ends.drop("_open"), 2 * stride


def explained_apart(cells: DataFrame, failing: DataFrame, x: str, y: str, family: str) -> DataFrame:
    """Failing cells (x, y, family) that no broken row or column of their family explains."""
    for line in (x, y):
        failing = failing.join(broken_lines(cells, failing, line, family).select(line, family).withColumn("_broken", F.lit(True)), [line, family], "left")
        failing = failing.withColumnRenamed("_broken", f"_{line}")
    return failing.where(f"_{x} IS NULL AND _{y} IS NULL").drop(f"_{x}", f"_{y}")


def by_precedence(rows: DataFrame, key: str, rank: str) -> DataFrame:
    """Of the rows of a key, those of the lowest rank; equal ranks of a key must not occur."""
    w = Window.partitionBy(key).orderBy(rank)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def updated_baseline(baseline: DataFrame, found: DataFrame, ran: DataFrame, all_keys: DataFrame, key: str, accept: bool) -> DataFrame:
    """The baseline after a run: of the keys that ran, what was found and known, or all that was found if new findings are
    accepted; of the others, what was known. Keys that exist no longer (all_keys) have no rows."""
    columns = baseline.columns
    known = found.select(columns) if accept else found.select(columns).join(baseline, columns, "left_semi")
    rest = baseline.join(ran.select(key), key, "left_anti").join(all_keys.select(key), key, "left_semi").select(columns)
    return known.join(ran.select(key), key, "left_semi").select(columns).unionByName(rest).distinct()
