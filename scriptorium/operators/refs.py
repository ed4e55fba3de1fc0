"""Labels, references and aliases as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def registry(labels: DataFrame, key: str, pos: str, *values: str) -> DataFrame:
    """One row per key: of several definitions the last one counts, of those at one place the one with the largest values."""
    rows = labels.groupBy(key).agg(F.max(F.struct(pos, *values)).alias("_last"), F.count("*").alias("definitions"))
    return rows.select(key, *(F.col(f"_last.{v}").alias(v) for v in values), "definitions")


def resolved(refs: DataFrame, labels: DataFrame, ref: str, key: str) -> DataFrame:
    """refs with the label's columns, null where it dangles."""
    return refs.join(labels, refs[ref] == labels[key], "left")


def dangling(refs: DataFrame, labels: DataFrame, ref: str, key: str) -> DataFrame:
    return refs.join(labels, refs[ref] == labels[key], "left_anti")


def with_aliases(labels: DataFrame, aliases: DataFrame, key: str, alias: str, kept: str) -> DataFrame:
    """labels and, for each alias that is no label itself, the kept label's row under the alias."""
    new = aliases.join(labels, aliases[alias] == labels[key], "left_anti")
    more = new.join(labels, new[kept] == labels[key]).select(F.col(alias).alias(key), *(c for c in labels.columns if c != key))
    return labels.unionByName(more)


def merged(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Rows of over, and those of base that it doesn't have."""
    return over.unionByName(base.join(over.select(key), key, "left_anti").select(over.columns))


#: Commands that print an entry, and the form of it; each also with pl for plurals and a capital for a capital.
FORMS = {"gls": "first", "acrshort": "short", "acrlong": "long", "acrfull": "full", "glsentryshort": "short", "glsentrylong": "long", "glsentryfull": "full"}


def entry_forms(spark) -> DataFrame:
    """command, form, ending, capital."""
    rows = [(base[:1].upper() + base[1:] if capital else base, form, ending, capital) for base, form in FORMS.items() for ending in ("", "s") for capital in (False, True)]
    return spark.createDataFrame([(name + ("pl" if ending else ""), form, ending, capital) for name, form, ending, capital in rows], "command string, form string, ending string, capital boolean")


def glossary_texts(uses: DataFrame, doc: list[str], order: list[str], acronyms: DataFrame, terms: DataFrame) -> DataFrame:
    """uses (command, label) with the text that each one prints.

    Commands are joined to their form, labels to their entry: an acronym (label, short, long), a term (label, name), whose
    forms are all its name, or none, which prints the label. The first use of an entry in a document by a form of "first"
    prints the full form, later ones the short one, which is also that of an unknown command. Labels are unique.
    """
    entries = acronyms.select("label", "short", "long", F.concat("long", F.lit("{} ("), "short", F.lit("{})")).alias("full"))
    entries = entries.unionByName(terms.select("label", F.col("name").alias("short"), F.col("name").alias("long"), F.col("name").alias("full")))
    entries = entries.select("label", F.explode(F.create_map(*(x for f in ("short", "long", "full") for x in (F.lit(f), F.col(f))))).alias("form", "pattern"))
    rows = uses.join(F.broadcast(entry_forms(uses.sparkSession)), "command", "left")
    first = F.row_number().over(Window.partitionBy(*doc, "label", F.col("form")).orderBy(*order)) == 1
    form = F.when(F.col("form") == "first", F.when(first, "full").otherwise("short")).otherwise(F.coalesce("form", F.lit("short")))
    rows = rows.withColumn("form", form).join(entries, ["label", "form"], "left")
    ending = F.coalesce("ending", F.lit(""))
    text = F.when(F.contains("pattern", F.lit("{}")), F.replace("pattern", F.lit("{}"), ending)).otherwise(F.concat("pattern", ending))
    capital = F.when(F.col("capital"), F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))).otherwise(text)
    return rows.withColumn("text", F.coalesce(capital, F.col("label").cast("string"))).drop("form", "ending", "capital", "pattern")
