"""Shared folder, size-checked broadcasts and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after a count has shown it to have at most so many rows of a few dozen bytes.
BROADCAST_ROWS = 400_000
#: Lets Spark delete an execution's shuffle files at its end; else they stay until the driver happens to collect garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's own folder below spark.checkpoint.dir, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local") and "local-cluster" not in spark.sparkContext.master:
        base = spark.conf.get("scriptorium.scratch", None) or tempfile.mkdtemp(prefix="scriptorium-")
        spark.conf.set("scriptorium.scratch", base)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/scriptorium-{spark.sparkContext.applicationId}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    was = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, was)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def drop(*kept: DataFrame) -> None:
    """Delete tables from keep() that nothing will read again, for disk; what was kept from them stays."""
    for df in kept:
        _delete(df.sparkSession, df._kept_at)


def release(spark: SparkSession) -> None:
    """Delete what keep() has written in this session. Results that read it must have been written before."""
    _delete(spark, shared_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_or_shuffled(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a kept frame if its counted size allows; else leave the join to a shuffle, which Spark can split."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def give_back() -> None:
    """Return what Arrow has freed in this worker to the machine: an idle worker lives on, beside those of later stages."""
    pa.default_memory_pool().release_unused()


def bit_table(df: DataFrame, column: str, least: int = 20, most: int = 28) -> np.ndarray:
    """A bit for each value (long, hashed) of a column, in a table that grows with the count of rows from 2^least to 2^most bits, 32 MB."""
    size = max(least, min(most, (16 * df.count()).bit_length()))
    words = df.selectExpr(f"shiftrightunsigned({column}, {64 - size}) AS place").selectExpr("shiftright(place, 6) AS word", "shiftleft(1L, int(place & 63)) AS bit")
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2^(most - 6) rows
    table = np.zeros(1 << (size - 6), np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return table


def has_bit(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values have their bit in a table of bit_table()."""
    place = values.view(np.uint64) >> np.uint64(64 - (len(table) * 64).bit_length() + 1)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b: long) by alternating large-star and small-star rounds.

    Returns (node, root), root being the smallest node of the component; nodes without an edge don't appear.
    Every round is a pair of aggregations and joins, so no component is held by one task.
    """
    spark = edges.sparkSession
    links = keep(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges")
    mark = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = keep(large.where("a <> b"), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        links = keep(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small")
        seen = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.withColumn("root", F.col("node")))
