"""Ranked search against a plain loop over documents and items."""

import collections
import math
import random
import re

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    asked = collections.defaultdict(collections.Counter)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for item, q in asked.items():
        found = []
        for i, b in bags:
            m = 75 + 25 * sum(b.values()) * n // length
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 12 * m)) for t, times in q.items() if t in b)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank + 1, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


RNG = random.Random(3)
WORDS = ["ab", "Cd", "é", "İx", "ß", "x9", "the", "THE", "a_b", "日本", "\U0001f600", "q"]


def made(n):
    return RNG.choice(["", " ", ", "]).join(RNG.choice(WORDS) + RNG.choice([" ", "\n", "-", "\x00", "'"]) for _ in range(n))


DOCS = [(i, made(RNG.randrange(1, 30))) for i in range(150)] + [(900 + i, "the ab ab Cd") for i in range(60)] + [(990, "AB the cd ab!!"), (None, "the ab ab cd"), (3, "the é"), (3, "the é"), (700, None), (701, ""), (702, " - "), (703, "zz " * 40_000 + "q x9")]
ITEMS = [(1, "the ab cd"), (2, made(40)), (3, None), (4, ""), (5, "unheard of"), (6, "é ß"), (6, "ab"), (None, "q x9 q"), (7, "the the"), (8, "the the")]


def same(spark, docs, frame, items, k=20, **more):
    from scriptorium.llm.lexical_search import ranked

    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS score", "2 AS rank", "3 AS doc_id")
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked(frame, bench, k, **more).collect()), key=repr)
    assert got == plain(docs, items, k)


def test_ranked(spark, docs):
    same(spark, DOCS, docs(DOCS), ITEMS)
    same(spark, DOCS, docs(DOCS).repartition(7), ITEMS, 3)


def test_blocks_of_items(spark, docs):
    same(spark, DOCS, docs(DOCS), ITEMS, 5, block_bytes=200)


def test_empty(spark, docs):
    same(spark, [], docs([]), ITEMS)
    same(spark, DOCS, docs(DOCS), [])
    same(spark, [(1, None), (2, "  ")], docs([(1, None), (2, "  ")]), ITEMS)


def test_one_hash_for_all(spark, docs, monkeypatch):
    """Classes are told apart by their terms, not by the hash alone."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    same(spark, DOCS, docs(DOCS), ITEMS[:3])
