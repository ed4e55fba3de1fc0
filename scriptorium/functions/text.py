"""String expressions: white space, escaping, names, numbers, lengths and colours. All are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters with a meaning in LaTeX, and what writes them.
LATEX = [("\\", r"\textbackslash{}"), ("{", r"\{"), ("}", r"\}"), ("$", r"\$"), ("&", r"\&"), ("#", r"\#"), ("%", r"\%"), ("_", r"\_"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}")]
#: EMU of a unit of length; an inch has 914,400, or 72.27 points, 72 big points or 96 pixels, and em and ex are those of ten-point type.
EMU = {"in": 914400, "pt": 914400 / 72.27, "bp": 914400 / 72, "cm": 914400 / 2.54, "mm": 914400 / 25.4, "px": 914400 / 96, "em": 914400 / 72.27 * 10, "ex": 914400 / 72.27 * 4.3}


def normal_space(c: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, "[ \\t\\n\\r]+", " "))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def latex_escape(c: Column) -> Column:
    """Escaped for LaTeX in one pass over the special characters: a private mark keeps replaced text from a second turn."""
    for i, (a, _) in enumerate(LATEX):
        c = F.replace(c, F.lit(a), F.lit(chr(0xE000 + i)))
    for i, (_, b) in enumerate(LATEX):
        c = F.replace(c, F.lit(chr(0xE000 + i)), F.lit(b))
    return c


def without_tags(c: Column) -> Column:
    return normal_space(F.regexp_replace(F.regexp_replace(c, "<(script|style)[^>]*>[^<]*</(script|style)>", " "), "<[^>]*>", " "))


def bookmark(c: Column, most: int = 40) -> Column:
    """A name of word characters that begins with a letter."""
    name = F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    return F.substring(F.when(name.rlike("^[A-Za-z]"), name).otherwise(F.concat(F.lit("ref_"), name)), 1, most)


def grouped_digits(c: Column, mark: str = ",") -> Column:
    """An integer's digits in threes."""
    return F.regexp_replace(c.cast("string"), "(?<=\\d)(?=(\\d{3})+$)", mark)


def initials(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))), " ")


def to_emu(c: Column, unit: str) -> Column:
    """A length in EMU, not rounded."""
    return c * F.lit(float(EMU[unit]))


def mixed_colour(a: list[Column], b: list[Column], percent: Column) -> Column:
    """Six hex digits of a colour mixed with another, channel by channel, halves to even."""
    mix = lambda x, y: F.lpad(F.hex(F.bround((x * percent + y * (100 - percent)) / 100).cast("long")), 2, "0")
    return F.concat(*(mix(x, y) for x, y in zip(a, b)))


def roman(c: Column) -> Column:
    """Lower-case Roman numeral of an integer from 1 to 3999."""
    rows = [("i", "v", "x"), ("x", "l", "c"), ("c", "d", "m"), ("m", "", "")]
    parts = []
    for k in reversed(range(4)):
        a, b, d = rows[k]
        digits = ["", a, a * 2, a * 3, a + b, b, b + a, b + a * 2, b + a * 3, a + d]
        parts.append(F.get(F.array(*map(F.lit, digits)), F.pmod(F.floor(c / 10**k), F.lit(10)).cast("int")))
    return F.concat(*parts)
