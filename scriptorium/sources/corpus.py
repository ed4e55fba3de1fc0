"""Corpora of LaTeX files: scan, inclusion of files, listings, and the split into preamble and body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources import tokens

#: A file name stands between two of these in a marked source, with the folder of the file that names it.
MARK = "\ue000"
INCLUDE = r"\\(?:input|include)\s*\{([^{}]+)\}"
LISTING = r"\\(?:lstinputlisting(?:\[[^\]]*\])?|verbatiminput)\s*\{([^{}]+)\}"
DEPTH = 20


def latex_files(spark: SparkSession, folder: str, pattern: str = "*.tex") -> DataFrame:
    """path, dir, source of every file below a folder; dir has no slash at its end. Bytes that aren't UTF-8 become marks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.decode("content", "UTF-8").alias("source"))


def _marked(source: Column, folder: Column, pattern: str) -> Column:
    """source with each name that pattern captures as MARK name MARK-free separator folder MARK."""
    quoted = F.regexp_replace(folder, r"([\\$])", r"\\$1")
    return F.regexp_replace(source, F.lit(pattern), F.concat(F.lit(MARK + "$1\t"), quoted, F.lit(MARK)))


def _filled(rows: DataFrame, bodies: DataFrame, extension: str) -> DataFrame:
    """rows (path, dir, source) with every marked name replaced by the body of that file, empty if there is none.

    A name is looked up in the row's folder first, then in that of the file that names it.
    """
    parts = rows.select("path", "dir", F.posexplode(F.split("source", MARK)).alias("pos", "part"))
    named = F.col("pos") % 2 == 1
    name = F.trim(F.split_part("part", F.lit("\t"), F.lit(1)))
    name = F.when(name.rlike(r"\.[A-Za-z0-9]+$"), name).otherwise(F.concat(name, F.lit(extension)))
    parts = parts.withColumn("first", F.when(named, F.concat("dir", F.lit("/"), name)))
    parts = parts.withColumn("second", F.when(named, F.concat(F.split_part("part", F.lit("\t"), F.lit(2)), F.lit("/"), name)))
    of = lambda key, body: bodies.select(F.col("path").alias(key), F.col("source").alias(body))
    found = parts.join(of("first", "a"), "first", "left").join(of("second", "b"), "second", "left")
    text = F.when(named, F.coalesce("a", "b", F.lit(""))).otherwise(F.col("part"))
    whole = found.groupBy("path", "dir").agg(F.sort_array(F.collect_list(F.struct("pos", text.alias("text")))).alias("parts"))
    return whole.select("path", "dir", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("source"))


def flattened(files: DataFrame, mains: DataFrame, depth: int = DEPTH) -> DataFrame:
    """path, dir, source of the main files (mains: path) with the files that they include, to the given depth.

    Each round is a join of all documents' open names with the files; rounds end when no name is open. What is deeper
    than depth, as in a file that includes itself, is left out. The session's checkpoint folder cuts the lineage.
    """
    context = files.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(files.sparkSession.conf.get("spark.checkpoint.dir"))
    bodies = files.select("path", "dir", _marked(F.col("source"), F.col("dir"), INCLUDE).alias("source"))
    done = bodies.join(mains.select("path"), "path", "left_semi")
    for _ in range(depth):
        still = done.where(F.contains("source", F.lit(MARK)))
        if still.isEmpty():
            return done
        done = done.where(~F.contains("source", F.lit(MARK))).unionByName(_filled(still, bodies, ".tex")).checkpoint()
    return done.withColumn("source", F.regexp_replace("source", f"{MARK}[^{MARK}]*{MARK}", ""))


def with_listings(sources: DataFrame, files: DataFrame) -> DataFrame:
    """sources (path, dir, source) with listing files as verbatim blocks; files: path, source of all that may be named."""
    marked = sources.select("path", "dir", _marked(F.col("source"), F.col("dir"), LISTING).alias("source"))
    block = F.concat(F.lit("\\begin{verbatim}\n"), F.col("source"), F.lit("\n\\end{verbatim}"))
    return _filled(marked, files.select("path", block.alias("source")), "")


def without_comments(source: Column) -> Column:
    """Without comments: from a per cent sign that no backslash escapes to the line's end, that end and the next indent. Verbatim stretches stay."""
    inner = tokens.PROTECTED.replace(r"\2", r"\3").replace(r"\1", r"\2")  # one more group around it
    return F.regexp_replace(source, rf"({inner}|(?s:\\.))|%[^\n]*\n?[ \t]*", "$1")


def parts(sources: DataFrame) -> DataFrame:
    """sources with preamble and body: what lies before and inside the document environment; all is body without one."""
    begin, end = "\\begin{document}", "\\end{document}"
    at = F.instr("source", begin)
    after = F.when(at > 0, F.substring("source", at + len(begin), F.length("source"))).otherwise(F.col("source"))
    preamble = F.when(at > 0, F.substring("source", F.lit(1), at - 1)).otherwise("")
    return sources.withColumn("preamble", preamble).withColumn("body", F.split_part(after, F.lit(end), F.lit(1)))


def blocks(bodies: DataFrame) -> DataFrame:
    """path, pos, block: paragraphs of body, which blank lines end; those of white space only are left out."""
    rows = bodies.select("path", F.posexplode(F.split("body", r"\n[ \t]*\n\s*")).alias("pos", "raw"))
    return rows.select("path", "pos", F.trim(F.regexp_replace("raw", r"\s+", " ")).alias("block")).where("block <> ''")


def labels(bodies: DataFrame) -> DataFrame:
    """path, pos, key of every label, in order."""
    return bodies.select("path", F.posexplode(F.regexp_extract_all("body", F.lit(r"\\label\{([^{}]+)\}"), 1)).alias("pos", "key"))


def references(bodies: DataFrame) -> DataFrame:
    """path, pos, kind, key of every reference; several keys in one are several rows."""
    pattern = r"\\(?:ref|eqref|pageref|cref|Cref|autoref|nameref)\{[^{}]+\}"
    rows = bodies.select("path", F.posexplode(F.regexp_extract_all("body", F.lit(pattern), 0)).alias("pos", "raw"))
    keys = F.explode(F.split(F.regexp_extract("raw", r"\{([^{}]+)\}", 1), r"\s*,\s*"))
    return rows.select("path", "pos", F.regexp_extract("raw", r"\\(\w+)", 1).alias("kind"), keys.alias("key"))


def headings(bodies: DataFrame) -> DataFrame:
    """path, pos, level (1 to 3), starred, title of every sectioning command, in order."""
    pattern = r"\\(?:sub){0,2}section\*?\{[^{}]*\}"
    rows = bodies.select("path", F.posexplode(F.regexp_extract_all("body", F.lit(pattern), 0)).alias("pos", "raw"))
    level = 1 + F.regexp_count(F.regexp_extract("raw", r"\\((?:sub)*)section", 1), F.lit("sub"))
    return rows.select("path", "pos", level.alias("level"), F.contains("raw", F.lit("section*")).alias("starred"), F.regexp_extract("raw", r"\{([^{}]*)\}", 1).alias("title"))
