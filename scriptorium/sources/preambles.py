r"""What preambles say of a document, read from the table of commands and their arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.markup import LANGUAGES
from scriptorium.sources import tokens
from scriptorium.sources.definitions import found_commands

#: Where a running head stands, best first: a command, and the kind and number of the argument.
RUNNING_HEADS = [("title", "[", 0), ("runninghead", "{", 0), ("shorttitle", "{", 0), ("markright", "{", 0), ("setheadertext", "{", 0), ("titlerunning", "{", 0), ("runningtitle", "{", 0), ("markboth", "{", 1)]
#: Where a main language stands, best first: a command, the kind of the argument, and the package or class that it must name.
LANGUAGES_OF = [("setmainlanguage", "{", None), ("setdefaultlanguage", "{", None), ("usepackage", "[", "babel"), ("documentclass", "[", None)]


def _argument(kind: str | Column, number: int | Column) -> Column:
    return F.get(F.filter("args", lambda a: a["kind"] == kind), number if isinstance(number, Column) else F.lit(number))


def arguments(sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """path, pos, rank, text, beside: the arguments that wanted (name, kind, number, rank) asks for, and the first group beside each."""
    names = [r["name"] for r in wanted.select("name").distinct().collect()]  # a few fixed ones
    rows = found_commands(sources, names).join(F.broadcast(wanted), "name")
    asked, group = _argument(F.col("kind"), F.col("number")), _argument("{", 0)
    rows = rows.select("path", "pos", "rank", *(arg[end].alias(f"{n}_{end}") for n, arg in (("a", asked), ("b", group)) for end in ("from", "to")))
    return tokens.texts_between(sources, rows, text=("a_from", "a_to"), beside=("b_from", "b_to")).select("path", "pos", "rank", "text", "beside").where("text IS NOT NULL")


def _wanted(sources: DataFrame, rows: list[tuple]) -> DataFrame:
    return sources.sparkSession.createDataFrame([(name, kind, number, rank) for rank, (name, kind, number) in enumerate(rows)], "name string, kind string, number int, rank int")


def _best(sources: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """path and the text of the best rank, at its first place; null for sources without any."""
    best = found.groupBy("path").agg(F.min_by("text", F.struct("rank", "pos")).alias(name))
    return sources.select("path").join(best, "path", "left")


def running_heads(sources: DataFrame) -> DataFrame:
    """path, head: a preamble's running head, white space made even; null without one that holds any text."""
    found = arguments(sources, _wanted(sources, RUNNING_HEADS))
    return _best(sources, found.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where("text <> ''"), "head")


def fonts(sources: DataFrame, command: str) -> DataFrame:
    """path, font that the first such command with any text sets."""
    found = arguments(sources, _wanted(sources, [(command, "{", 0)])).withColumn("text", F.trim("text")).where("text <> ''")
    return _best(sources, found, "font")


def main_languages(sources: DataFrame) -> DataFrame:
    """path, lang: the code of a preamble's main language, by LANGUAGES_OF; of options the one after main= counts, else the last that is known."""
    spark = sources.sparkSession
    found = arguments(sources, _wanted(sources, [(name, kind, 0) for name, kind, _ in LANGUAGES_OF]))
    package = F.get(F.array(*(F.lit(p) for *_, p in LANGUAGES_OF)), F.col("rank"))
    found = found.where(package.isNull() | (F.trim("beside") == package))
    options = found.select("path", "rank", "pos", F.posexplode(F.split("text", ",")).alias("n", "option"))
    options = options.withColumn("option", F.lower(F.trim("option"))).withColumn("main", F.startswith("option", F.lit("main=")))
    known = spark.createDataFrame(list(LANGUAGES.items()), "name string, lang string")
    named = options.withColumn("name", F.regexp_replace("option", "^main=", "")).join(F.broadcast(known), "name")
    best = named.groupBy("path").agg(F.min_by("lang", F.struct("rank", ~F.col("main"), -F.col("pos"), -F.col("n"))).alias("lang"))
    return sources.select("path").join(best, "path", "left")
