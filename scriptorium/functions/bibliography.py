"""Names of authors, identifiers of works and shares of lengths as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_names(raw: Column) -> Column:
    """Array of structs (family, given) of names joined by and: Family, Given, or else the last word is the family's."""
    names = F.filter(F.transform(F.split(raw, r"\s+and\s+"), F.trim), lambda n: n != "")

    def split(name: Column) -> Column:
        comma = F.contains(name, F.lit(","))
        family = F.when(comma, F.trim(F.split_part(name, F.lit(","), F.lit(1)))).otherwise(F.regexp_extract(name, r"(\S+)$", 1))
        given = F.when(comma, F.trim(F.regexp_extract(name, r"^[^,]*,(.*)$", 1))).otherwise(F.trim(F.regexp_replace(name, r"\S+$", "")))
        return F.struct(family.alias("family"), given.alias("given"))

    return F.transform(names, split)


def initials(given: Column) -> Column:
    """The first letter of each word with a full stop, spaces between."""
    words = F.filter(F.split(given, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.substring(w, 1, 1), F.lit("."))), " ")


def author_list(names: Column) -> Column:
    """Structs (family, given) as Family, I. joined by commas, an ampersand before the last; empty without a name."""
    each = F.transform(names, lambda n: F.when(n["given"] == "", n["family"]).otherwise(F.concat(n["family"], F.lit(", "), initials(n["given"]))))
    n = F.size(names)
    head = F.array_join(F.slice(each, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n < 2, F.array_join(each, "")).otherwise(F.concat(head, F.lit(" & "), F.element_at(each, -1)))


def numeric_id(key: Column) -> Column:
    """A number of 31 bits that stands for a key in citation fields."""
    return F.crc32(F.encode(key, "utf-8")).bitwiseAND(F.lit(2_147_483_647))


def relative_length(length: Column) -> Column:
    """The share of a text, line or column width; 1 if its factor is no number, null for a length of another kind."""
    factor = F.regexp_extract(length, r"^\s*([^\\]*?)\s*\\(?:text|line|column)width", 1).try_cast("double")
    return F.when(length.rlike(r"\\(?:text|line|column)width"), F.coalesce(factor, F.lit(1.0)))
