"""BibTeX files as rows of fields: braces are counted by window functions, so they may nest to any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.sources.tokens import spread

#: A brace, or an @, with the text up to the next one; or the text before the first.
PIECES = r"[{}@][^{}@]*|^[^{}@]+"
#: Characters of files that a task works on at a time, as about so many, or one longer file. A piece is some dozen characters.
PART = 1 << 22
#: Stands before a digit for what separates nothing inside of braces or quotes, and for itself; a noncharacter, but sources may hold it.
_ESCAPE = "\ufdd0"
_HIDDEN = {_ESCAPE: "0", ",": "1", "=": "2", '"': "3"}
_BLANK = " \t\r\n"


def _hidden(c: Column, *what: str) -> Column:
    for w in what:
        c = F.replace(c, F.lit(w), F.lit(_ESCAPE + _HIDDEN[w]))
    return c


def _shown(c: Column) -> Column:
    for w in reversed(_HIDDEN):
        c = F.replace(c, F.lit(_ESCAPE + _HIDDEN[w]), F.lit(w))
    return c


def _entries(files: DataFrame) -> DataFrame:
    """path, entry (from 1), type, fields (texts between commas, with hidden characters) of every entry of files (path, text)."""
    rows = spread(files, "path", "text", PART).select("path", F.posexplode(F.regexp_extract_all("text", F.lit(PIECES), 0)).alias("pos", "piece"))
    first = F.substring("piece", 1, 1)
    rows = rows.withColumn("mark", F.when(first.isin("{", "}", "@"), first).otherwise(""))
    rows = rows.withColumn("rest", F.expr("substring(piece, length(mark) + 1)")).drop("piece")
    change = F.when(F.col("mark") == "{", 1).when(F.col("mark") == "}", -1).otherwise(0)
    in_order = Window.partitionBy("path").orderBy("pos")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sum", F.sum(change).over(so_far))
    rows = rows.withColumn("indent", F.col("sum") - F.least(F.lit(0), F.min("sum").over(so_far)))
    rows = rows.withColumn("depth", F.lag("indent", 1, 0).over(in_order))
    rows = rows.withColumn("entry", F.sum(((F.col("mark") == "@") & (F.col("depth") == 0)).cast("int")).over(so_far)).where("entry > 0")
    head = F.when((F.col("indent") == 0) & (F.col("rest") != ""), F.lower(F.trim(F.regexp_extract("rest", '^(?:[^,="]+|[,="])', 0))))
    mark = F.when((F.col("depth") > 0) & (F.col("indent") > 0), F.col("mark")).otherwise("")
    rest = F.when(F.col("indent") == 1, _hidden(F.col("rest"), _ESCAPE)).when(F.col("indent") > 1, _hidden(F.col("rest"), *_HIDDEN)).otherwise("")
    entries = rows.groupBy("path", "entry").agg(F.sort_array(F.collect_list(F.struct("pos", head.alias("head"), F.concat(mark, rest).alias("body")))).alias("p"))
    kind = F.get(F.filter(F.transform("p", lambda x: x["head"]), lambda h: h.isNotNull()), F.lit(0))
    parts = F.split(F.array_join(F.transform("p", lambda x: x["body"]), ""), '"', -1)  # every other one stands in quotes
    parts = F.transform(parts, lambda x, i: F.when(i % 2 == 1, _hidden(x, ",", "=")).otherwise(x))
    return entries.select("path", "entry", kind.alias("type"), F.split(F.array_join(parts, '"'), ",", -1).alias("fields"))


def fields(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, key, type, name, value of every field of files.

    Entries begin at an @ outside all braces; what stands between them is passed over. Braces and quotes around a value
    are dropped, a value that names an @string of the file is that string. Names, types and names of strings are compared in
    lower case; of equal keys the last entry holds, of equal names in an entry the last field. Comments, preambles and entries
    without a key give no rows; null texts neither. Files are dealt by size and path once; all windows and groups lie within
    a path. A file's pieces (braces with the text behind) are sorted in one task, an entry's gathered in a row.
    """
    entries = _entries(files.select(F.col(path).alias("path"), F.col(text).alias("text")).where("path IS NOT NULL"))
    begin = F.get("fields", F.lit(0))
    key = F.when(~F.contains(begin, F.lit("=")) & ~F.col("type").isin("string", "comment", "preamble"), F.nullif(F.trim(_shown(begin), F.lit(_BLANK)), F.lit("")))
    entries = entries.withColumn("key", key).where("key IS NOT NULL OR type = 'string'")
    last = F.max("entry").over(Window.partitionBy("path", "key"))
    entries = entries.withColumn("last", last).where("key IS NULL OR entry = last").drop("last")
    found = entries.select("path", "key", "type", "entry", F.posexplode("fields").alias("field", "pair")).where(F.contains("pair", F.lit("=")))
    at = F.instr("pair", "=")
    name, raw = F.lower(F.trim(_shown(F.substring("pair", F.lit(1), at - 1)), F.lit(_BLANK))), F.trim(_shown(F.substring("pair", at + 1, F.length("pair"))), F.lit(_BLANK))
    found = found.withColumn("name", name).withColumn("raw", raw).drop("pair")
    found = found.withColumn("value", F.regexp_replace("raw", r"(?s)^(?:\{(.*)\}|\"(.*)\")$", "$1$2"))
    # strings and fields by the name that they give or ask for, in the place of a join, which would shuffle anew
    found = found.withColumn("macro", F.when(F.col("key").isNull(), F.col("name")).otherwise(F.lower("raw")))
    meant = F.max(F.when(F.col("key").isNull(), F.struct("entry", "field", "value"))).over(Window.partitionBy("path", "macro"))
    found = found.withColumn("value", F.coalesce(meant["value"], "value")).where("key IS NOT NULL")
    again = F.max("field").over(Window.partitionBy("path", "key", "name"))
    return found.withColumn("again", again).where("field = again").select("path", "key", "type", "name", "value")


def plain_value(c: Column) -> Column:
    """A field's value without TeX: escapes, ties and dashes as characters, no braces, single spaces. Accents stay as commands."""
    out = F.regexp_replace(c, r"\\([&%$#_])", "$1")
    out = F.replace(F.replace(F.replace(out, F.lit("---"), F.lit("—")), F.lit("--"), F.lit("–")), F.lit("~"), F.lit(" "))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[{}]", ""), r"\s+", " "))
