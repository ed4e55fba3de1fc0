from pyspark.sql import functions as F

from scriptorium.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    assert one(spark, T.roman(F.lit(1994))) == "mcmxciv"
    assert one(spark, T.roman(F.lit(3))) == "iii"
    assert one(spark, T.latex_escape(F.lit("a_b\\{%}"))) == r"a\_b\textbackslash{}\{\%\}"
    assert one(spark, T.grouped_digits(F.lit(1234567))) == "1,234,567"
    assert one(spark, T.normal_space(F.lit("  a \n b "))) == "a b"
    assert one(spark, T.initials(F.lit("ada lovelace"))) == "A. L."
    assert one(spark, T.to_emu(F.lit(1.5), "in")) == 1371600.0
    assert one(spark, T.mixed_colour([F.lit(255)] * 3, [F.lit(0)] * 3, F.lit(50))) == "808080"
