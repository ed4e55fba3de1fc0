"""Images beside a corpus: paths resolved to files, and width and height read from the first bytes of a file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Extensions tried in this order for a name that is no file itself.
EXTENSIONS = [".pdf", ".png", ".jpg", ".jpeg", ".eps", ".ps"]
#: Width and height taken for an image whose size isn't known, 4 by 3 inches.
DEFAULT_SIZE = (384, 288)
#: The first bytes of a PNG file, in hex.
PNG = "89504E470D0A1A0A"


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, content of every file below a folder with one of the extensions; content is read only where used."""
    pattern = "*.{" + ",".join(e[1:] for e in EXTENSIONS) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", "content")


def png_size(content: Column) -> Column:
    """width and height of a PNG file as a struct; null for other files and those cut off before the sizes."""
    head = F.hex(F.substring(content, 1, 24))
    number = lambda at: F.conv(F.substring(head, at, 8), 16, 10).cast("long")
    return F.when(head.startswith(PNG) & (F.length(head) == 48), F.struct(number(33).alias("width"), number(41).alias("height")))


def _frame_size(data: bytes) -> tuple[int, int] | None:
    """Width and height in the first frame header of a JPEG file."""
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while 0 <= (at := data.find(0xFF, at)) < len(data) - 8:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
        if kind == 0xFF:  # fill
            at += 1
        elif kind >> 4 == 0xC and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7])
        else:
            at += 2 if kind in (0, 1) or 0xD0 <= kind <= 0xD8 else 2 + size
    return None


def jpeg_size(content: Column, head: int = 1 << 16) -> Column:
    """width and height of a JPEG file as a struct; null for other files and those without a frame header in the first bytes."""

    @F.pandas_udf("width long, height long")
    def sizes(heads: pd.Series) -> pd.DataFrame:
        found = [_frame_size(bytes(h)) if h is not None else None for h in heads]
        return pd.DataFrame([f or (None, None) for f in found], columns=["width", "height"]).astype("Int64")

    size = sizes(F.substring(content, 1, head))
    return F.when(size["width"].isNotNull(), size)


def image_size(content: Column) -> Column:
    """width and height of a PNG or JPEG file; the default size for all others."""
    return F.coalesce(png_size(content), jpeg_size(content), F.struct(*(F.lit(n).cast("long").alias(c) for n, c in zip(DEFAULT_SIZE, ("width", "height")))))


def resolved(names: DataFrame, files: DataFrame) -> DataFrame:
    """names (dir, name, and more) with path: the file of that name in dir, else the first that an extension makes one.

    path is null if there is none. Files: path, which must be unique.
    """
    tried = F.array(F.lit(""), *map(F.lit, EXTENSIONS))
    rows = names.withColumn("_id", F.struct("dir", "name"))
    keys = rows.select("_id", "dir", "name").distinct()
    keys = keys.select("_id", F.posexplode(F.transform(tried, lambda e: F.concat("dir", F.lit("/"), "name", e))).alias("_rank", "path"))
    found = keys.join(files.select("path"), "path").groupBy("_id").agg(F.min_by("path", "_rank").alias("path"))
    return rows.join(found, "_id", "left").drop("_id")


def numbered(media: DataFrame, by: str, content: str = "content") -> DataFrame:
    """media with media_id: equal contents of a document share one, counted from 1 in the order of their hashes."""
    rows = media.withColumn("_hash", F.sha2(content, 256))
    ids = rows.select(by, "_hash").distinct()
    ids = ids.withColumn("media_id", F.row_number().over(Window.partitionBy(by).orderBy("_hash")))
    return rows.join(ids, [by, "_hash"]).drop("_hash")
