"""Names, identifiers and relative lengths."""

from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import bibliography as B
from scriptorium.operators import citations


@pytest.mark.parametrize(
    ("raw", "names", "listed"),
    [
        ("Knuth, Donald E.", [("Knuth", "Donald E.")], "Knuth, D. E."),
        ("Ada Lovelace and  Babbage, Charles", [("Lovelace", "Ada"), ("Babbage", "Charles")], "Lovelace, A. & Babbage, C."),
        ("A B and Plato and C D", [("B", "A"), ("Plato", ""), ("D", "C")], "B, A., Plato & D, C."),
        ("Anderson", [("Anderson", "")], "Anderson"),
        ("", [], ""),
    ],
)
def test_names(spark, raw, names, listed):
    row = spark.createDataFrame([(raw,)], "raw string").select(B.split_names(F.col("raw")).alias("n")).select("n", B.author_list(F.col("n")).alias("s")).first()
    assert [tuple(n) for n in row["n"]] == names and row["s"] == listed


def test_numbers(spark):
    df = spark.createDataFrame([("0.5\\textwidth",), ("\\linewidth",), ("x\\columnwidth",), ("3cm",), (None,)], "c string")
    assert [r[0] for r in df.select(B.relative_length(F.col("c"))).collect()] == [0.5, 1.0, 1.0, None, None]
    assert [r[0] for r in df.select(B.numeric_id(F.col("c"))).collect()][:1] == [crc32(b"0.5\\textwidth") & 0x7FFFFFFF]


def test_year_letters_go_on_after_z(spark):
    items = spark.range(800).selectExpr("'A' AS author", "1 AS year", "id + 1 AS n").union(spark.sql("SELECT 'B', 1, 1L"))
    got = {(r["author"], r["n"]): r["letter"] for r in citations.year_letters(items, "author", "year", "n").collect()}
    assert [got["A", n] for n in (1, 26, 27, 52, 53, 160, 702, 703, 800)] == ["a", "z", "aa", "az", "ba", "fd", "zz", "aaa", "adt"] and got["B", 1] == ""
    assert len(set(got.values())) == 801


def test_year_letters_equal_sql_on_many_suppliers(spark, tmp_path):
    from scriptorium.plans import queries as plans

    spark.sql("SELECT id AS s_suppkey, id % 2 AS s_nationkey FROM range(8000)").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.sql("SELECT id AS n_nationkey, 'N' || id AS n_name FROM range(2)").write.parquet(str(tmp_path / "nation.parquet"))
    con = duckdb.connect()
    for t in ("supplier", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = plans.QUERIES["bibliography_author_year"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(plans.SQL["bibliography_author_year"]).fetchall())
