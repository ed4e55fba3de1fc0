"""Numerals, lists, names, colours, lengths and clean-up of text as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Footnote marks of the numbers from 1.
FOOTNOTE_MARKS = ["*", "†", "‡", "§", "¶", "‖", "**", "††"]


def letters(n: Column) -> Column:
    """a to z, aa, ab and so on: base 26 without a zero; empty for numbers below 1."""
    start = F.struct(n.cast("long").alias("n"), F.lit("").alias("s"))

    def step(state: Column, _: Column) -> Column:
        more = state["n"] > 0
        rest = F.when(more, F.floor((state["n"] - 1) / 26)).otherwise(F.lit(0)).cast("long")
        digit = F.char(F.pmod(state["n"] - 1, F.lit(26)) + 97)
        return F.struct(rest.alias("n"), F.when(more, F.concat(digit, state["s"])).otherwise(state["s"]).alias("s"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda state: state["s"])


def footnote_mark(n: Column) -> Column:
    """A mark for 1 to 8, else the digits."""
    return F.coalesce(F.get(F.array(*map(F.lit, FOOTNOTE_MARKS)), (n - 1).cast("int")), n.cast("string"))


def angle(c: Column) -> Column:
    """d;m;s as degrees, minutes and seconds; minutes and seconds that are zero or absent are left out."""
    parts = F.split(c, ";")
    part = lambda i, mark: F.when(F.coalesce(F.get(parts, F.lit(i)), F.lit("")).isin("", "0"), "").otherwise(F.concat(F.get(parts, F.lit(i)), F.lit(mark)))
    return F.concat(F.get(parts, F.lit(0)), F.lit("°"), part(1, "′"), part(2, "″"))


def listed(items: Column, last: str = " and ", between: str = ", ") -> Column:
    """An array of strings as one: a, b and c. Empty for an empty array."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), between)
    return F.when(n < 2, F.array_join(items, between)).otherwise(F.concat(head, F.lit(last), F.element_at(items, -1)))


def author_label(families: Column, otherwise: Column) -> Column:
    """otherwise without an author, one name, two joined by an ampersand, or the first and others."""
    n = F.size(families)
    first = F.get(families, F.lit(0))
    return F.when(n == 0, otherwise).when(n == 1, first).when(n == 2, F.array_join(families, " & ")).otherwise(F.concat(first, F.lit(" et al.")))


def year(c: Column) -> Column:
    """The first four digits in a row, else n.d."""
    return F.coalesce(F.nullif(F.regexp_extract(c, "[0-9]{4}", 0), F.lit("")), F.lit("n.d."))


def prose_key(c: Column) -> Column:
    """What stays the same when prose is set anew: no white space, braces, colons or underscores; lower case."""
    return F.lower(F.regexp_replace(c, "[ \\t\\n\\r{}:_]+", ""))


def tidy(c: Column) -> Column:
    """Single spaces, and none before closing punctuation or at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[ \\t\\n\\r]+", " "), " ([,.;:!?)\\]}])", "$1"))


def scrubbed(c: Column) -> Column:
    """Form feeds as blank lines; no other control characters but tabs and line ends."""
    return F.regexp_replace(F.replace(c, F.lit("\f"), F.lit("\n\n")), "[\\x01-\\x08\\x0B\\x0E-\\x1F]", "")


def occurrences(c: Column, token: Column) -> Column:
    """Times that a token occurs, overlaps not counted."""
    return F.floor((F.length(c) - F.length(F.replace(c, token, F.lit("")))) / F.length(token)).cast("long")


def hex_channel(c: Column) -> Column:
    """Two hex digits of a channel: halves to even, held to 0 to 255."""
    return F.lpad(F.hex(F.least(F.greatest(F.bround(c).cast("long"), F.lit(0)), F.lit(255))), 2, "0")


def grey(percent: Column) -> Column:
    one = hex_channel(percent * 255 / 100)
    return F.concat(one, one, one)


def cmyk(c: Column, m: Column, y: Column, k: Column) -> Column:
    """Six hex digits of a colour in per cent of ink."""
    return F.concat(*(hex_channel((100 - x) * (100 - k) * 255 / 10000) for x in (c, m, y)))


def rotation(degrees: Column) -> Column:
    """Clockwise sixty-thousandths of a degree of an anticlockwise angle in whole degrees."""
    return F.pmod(-degrees, F.lit(360)) * 60000


def fitted(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """A width and height in EMU, both made smaller alike if the width is over most."""
    over = width > most
    return F.when(over, F.lit(most)).otherwise(width).cast("long"), F.when(over, F.floor(height * most / width)).otherwise(height).cast("long")


#: Bibliography styles of the author-year family; all others are numeric.
AUTHOR_YEAR = ["plainnat", "apalike", "abbrvnat", "agsm", "harvard", "chicago", "apa", "author-year"]


def style_family(c: Column) -> Column:
    """The family of a bibliography style: author-year or numeric, which is also that of an unknown or no style."""
    return F.when(F.lower(F.trim(c)).isin(AUTHOR_YEAR), "author-year").otherwise("numeric")


def first_upper(c: Column) -> Column:
    """The first character in upper case, the others as they are."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def changed_case(c: Column, kind: Column, upper: bool) -> Column:
    """Text in upper or lower case; mathematics and notes, which have another kind, are untouched."""
    return F.when(kind == "text", F.upper(c) if upper else F.lower(c)).otherwise(c)


def page_columns(source: Column) -> Column:
    """Columns of a page: the most of one, two for the option or command twocolumn, and those of any multicols block."""
    words = F.regexp_extract_all(source, F.lit(r"\\documentclass\s*\[[^\]]*\]|\\twocolumn(?![A-Za-z])|\\begin\{multicols\*?\}\s*\{\d+\}"), 0)
    option = lambda w: F.array_contains(F.split(F.regexp_replace(w, r"[\s\]]|^[^\[]*\[", ""), ","), "twocolumn")
    of = lambda w: F.when(F.startswith(w, F.lit(r"\begin")), F.regexp_extract(w, r"(\d+)\}$", 1).cast("int")).when(F.startswith(w, F.lit(r"\two")) | option(w), 2).otherwise(1)
    return F.aggregate(F.transform(words, of), F.lit(1), lambda a, b: F.greatest(a, b))


def without_pauses(source: Column) -> Column:
    """Slides without pause and onslide commands and their options."""
    pieces = F.regexp_extract_all(source, F.lit(r"\\[A-Za-z]+(?:\s*\[[^\]]*\])?|[^\\]+|\\"), 0)
    return F.array_join(F.filter(pieces, lambda p: ~F.regexp_extract(p, r"^\\([A-Za-z]+)", 1).isin("pause", "onslide")), "")


def long_date(c: Column) -> Column:
    """A date as Month D, YYYY."""
    return F.date_format(c, "MMMM d, yyyy")


def has_cjk(c: Column) -> Column:
    """Whether a text has kana, ideographs, Hangul or full-width forms and needs their font."""
    return F.coalesce(c.rlike("[\\u3040-\\u30ff\\u3400-\\u9fff\\uac00-\\ud7af\\uff00-\\uffef]"), F.lit(False))
