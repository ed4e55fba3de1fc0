"""Alignment of two versions: what the steps say, and difflib where it can only say the same."""

import random
from difflib import SequenceMatcher

from scriptorium.operators import reconcile

RNG = random.Random(8)


def steps(spark, versions):
    side = lambda k: spark.createDataFrame([(d, i, s) for d, v in versions.items() for i, s in enumerate(v[k])], "doc long, i long, s string").repartition(3)
    out = {d: [] for d in versions}
    for r in reconcile.aligned(side(0), side(1), "doc", "i", "s").orderBy("doc", "step").collect():
        assert r.step == len(out[r.doc])
        out[r.doc].append((r.tag, r.old_from, r.old_to, r.new_from, r.new_to))
    return out


def check(old, new, found):
    i = j = 0
    for tag, a, b, c, d in found:
        assert (a, c) == (i, j)
        i, j = b, d
        if tag == "equal":
            assert old[a:b] == new[c:d] and b > a
        else:
            assert tag == ("replace" if b > a and d > c else "delete" if b > a else "insert") and (b > a or d > c)
    assert (i, j) == (len(old), len(new))
    return sum(b - a for tag, a, b, _, _ in found if tag == "equal")


def longest(old, new):
    """The longest common subsequence of sequences without repeats, by all pairs."""
    best = [0] * (len(new) + 1)
    for x in old:
        row = [0]
        for k, y in enumerate(new):
            row.append(best[k] + 1 if x == y else max(row[k], best[k + 1]))
        best = row
    return best[-1]


def test_aligned(spark):
    versions = {}
    for d in range(40):  # edits in place, of texts that occur once
        old = [f"t{d}.{n}" for n in range(RNG.randrange(30))]
        new = [s if RNG.random() < 0.7 else f"n{d}.{n}" for n, s in enumerate(old) if RNG.random() < 0.85]
        versions[d] = (old, new)
    for d in range(100, 120):  # moved texts: a longest chain
        old = [f"m{n}" for n in range(25)]
        versions[d] = (old, RNG.sample(old, 20))
    for d in range(200, 240):  # many repeats
        versions[d] = tuple([RNG.choice("abc") for _ in range(RNG.randrange(1, 15))] for _ in range(2))
    versions[300] = (["x"], [])
    versions[301] = ([], ["x", "y"])
    versions[302] = (["a", "b", "c", "a"], ["a", "b", "c", "a"])
    versions[303] = (["hi"] * 5, ["hi"] * 3)
    versions[304] = (["u"] + ["hi"] * 400 + ["v"], ["w"] + ["hi"] * 300 + ["v", "z"])
    found = steps(spark, versions)
    for d, (old, new) in versions.items():
        same = check(old, new, found[d])
        if d < 100 or d >= 300 and d < 304:
            assert found[d] == SequenceMatcher(None, old, new, autojunk=False).get_opcodes()
        elif d < 120:
            assert same == longest(old, new)


def test_a_long_one(spark):
    old = [f"t{n}" if n % 10 else "ok" for n in range(12_000)]
    new = [s for n, s in enumerate(old) if n % 7] + ["end"]
    found = steps(spark, {1: (old, new)})[1]
    assert check(old, new, found) == len(new) - 1
