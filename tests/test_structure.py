"""Chains, ties of definitions, broken lines and names, on small cases."""

from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import findings, refs, structure


def test_chains_end_wherever_they_end(spark):
    links = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 200), (300, 200)]
    got = dict(map(tuple, structure.chain_ends(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    assert got == {**{i: 100 for i in range(100)}, 200: None, 201: None, 300: None}
    assert structure.chain_ends(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_the_last_definition_is_one_row(spark):
    rows = spark.createDataFrame([("k", 1, "a", 9), ("k", 2, "b", 1), ("k", 2, "c", 0), ("l", 1, None, None)], "key string, pos long, v string, w long")
    assert sorted(map(tuple, refs.registry(rows, "key", "pos", "v", "w").collect())) == [("k", "c", 0, 3), ("l", None, None, 1)]


def test_broken_lines_and_what_they_leave(spark):
    cells = spark.createDataFrame([(x, y) for x in "abc" for y in "12345"], "x string, y string")
    failing = spark.createDataFrame([("a", "1", "f"), ("a", "2", "f"), ("a", "3", "f"), ("b", "4", "f"), ("b", "4", "g")], "x string, y string, family string")
    assert [tuple(r) for r in findings.broken_lines(cells, failing, "x", "family").collect()] == [("a", "f", 3, 5)]
    assert {tuple(r) for r in structure.explained_apart(cells, failing, "x", "y", "family").select("x", "y", "family").collect()} == {("b", "4", "f"), ("b", "4", "g")}


def test_bookmark(spark):
    rows = spark.createDataFrame([("fig:a b",), ("1st",), ("",), ("x" * 60,), ("é1",)], "k string")
    assert [r[0] for r in rows.select(T.bookmark(F.col("k"))).collect()] == ["fig_a_b", "ref_1st", "ref_", "x" * 40, "ref__1"]
