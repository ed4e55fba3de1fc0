"""Innermost spans and counts inside spans against loops over all spans."""

import random

from pyspark.sql import functions as F

from scriptorium.operators import tree

RNG = random.Random(6)


def laminar(lo, hi, out):
    """Random spans that nest, some of them equal, some with ends in common."""
    while lo < hi and RNG.random() < 0.8:
        a = RNG.randrange(lo, hi)
        b = RNG.randrange(a + 1, hi + 1)
        out.append((a, b))
        if RNG.random() < 0.2:
            out.append((a, b))
        laminar(a, b, out) if b - a > 1 else None
        lo = b


def test_innermost_and_held(spark):
    spans, points = [], []
    for doc in range(60):
        own = []
        laminar(0, 40, own)
        spans += [(doc, a, b, n) for n, (a, b) in enumerate(own)]
        points += [(doc, RNG.randrange(-2, 45), n) for n in range(25)]
    spans += [(90, 0, 5, 0)]
    points += [(91, 3, 0)]
    s, p = spark.createDataFrame(spans, "doc long, a long, b long, n long"), spark.createDataFrame(points, "doc long, at long, id long")
    got = {(r.doc, r.id): r.n for r in tree.innermost(p, s, "doc", "at", "a", "b", ["n"]).collect()}
    assert len(got) == len(points)
    for doc, at, i in points:
        around = [(a, -b, n) for d, a, b, n in spans if d == doc and a <= at < b]
        assert got[doc, i] == (max(around)[2] if around else None)
    found = tree.held(s, p, "doc", "at", "a", "b", all=F.lit(1), even=F.col("id") % 2 == 0).collect()
    assert len(found) == len(spans)
    for r in found:
        inside = [i for d, at, i in points if d == r.doc and r.a <= at < r.b]
        assert (r["all"], r.even) == (len(inside), sum(i % 2 == 0 for i in inside))


def test_tasks_of_innermost_stay_small_as_points_grow(spark, monkeypatch):
    monkeypatch.setattr(tree, "PART", 500, raising=False)
    points = spark.range(4000).selectExpr("id % 400 AS doc", "id AS at")
    spans = spark.range(400).selectExpr("id AS doc", "0L AS a", "2000L AS b", "id AS n")
    got = tree.innermost(points, spans, "doc", "at", "a", "b", ["n"])
    assert got.rdd.getNumPartitions() > 4800 // 500
    assert got.where("n = doc").count() == got.where("at < 2000").count() == 2000 and got.count() == 4000
