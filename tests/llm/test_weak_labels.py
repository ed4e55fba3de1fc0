"""Labellers of abuse in languages without a list, and the defined cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from scriptorium.llm import weak_labels as L

STEMS = {"x": ["grobak", "zwist"], "y": ["malou", "fétiv"], "z": ["bruxo", "cordel"]}


def texts(seed, n=900):
    """(doc_id, text, toxic) in three invented languages; a sixth have words of abuse with varied endings."""
    rng = random.Random(seed)
    vocabulary = {lang: ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(400)] for lang, parts in (("x", ["en", "ung", "sta", "lich", "be"]), ("y", ["eau", "ré", "tion", "que", "le"]), ("z", ["ado", "mente", "ra", "co", "es"]))}
    rows = []
    for i in range(n):
        lang = "xyz"[i % 3]
        toxic = int(rng.random() < 1 / 6)
        words = rng.choices(vocabulary[lang], k=rng.randint(30, 120))
        for _ in range(len(words) // 15 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(STEMS[lang]) + rng.choice(vocabulary[lang]))
        rows.append((i, " ".join(words) + ".", toxic))
    return rows


def test_abuse_without_a_list(spark):
    rows = texts(1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    said = spark.createDataFrame([(i, 1, t) for i, _, t in rows if i % 2 == 0], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.clean_score < 0.5 for r in L.judged(docs, said).collect()}
    for lang in range(3):
        held = [(got[i], t) for i, _, t in rows if i % 2 and i % 3 == lang]
        assert sum(g for g, t in held if t) >= 0.8 * sum(t for _, t in held)
        assert sum(g for g, t in held if not t) <= 0.05 * sum(1 - t for _, t in held)


def test_learned_terms_against_counting(spark):
    rows = texts(2, 300)
    rows += [(1000 + i, rows[[r[2] for r in rows].index(1)][1], 1) for i in range(40)]  # copies of one toxic text count once
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    terms, keys = L.learned_terms(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    toxic, clean = defaultdict(set), Counter()
    for _, text, bad in rows:
        words = [re.sub(rb"(?<=.)[.,;:!?]$", b"", w) for w in text.lower().encode().split()]
        for kind in (4, 6, None):
            held = [w[:kind] for w in words]
            for term, count in Counter(held).items():
                at = held.index(term)
                beside = (words[at - 1] if at else None, words[at + 1] if at + 1 < len(words) else None)
                for level, rate in enumerate(L.RATES):
                    if 1000 * count >= rate * len(words):
                        if bad:
                            toxic[kind, term, level].add(beside)
                        else:
                            clean[kind, term, level] += 1
    t, n = (sum(r[2] == k for r in rows) for k in (1, 0))
    want = set()
    for key, found in toxic.items():
        a, b = len(found), clean[key]
        if a * (1 - L.PRECISION) >= b * L.PRECISION and a * math.log(a * (n + 1) / ((b + 1) * (t + 1))) >= L.GAIN:
            want.add(key)
    assert len(want) > 4 and len(keys) == len(want)
    assert len(terms) == len({(k, w) for k, w, _ in want})


def test_lists_apply_to_english_only():
    said = ["the vile man is in the house of the king", "la vile est rée que eau tion", "is it in the house of the king", "eau que tion", None, ""]
    got = {i: dict(zip(L.VOTES, v)) for i, v, _ in L._analysed(pa.array(said), L.NO_TERMS)}
    assert [got[i]["others"] for i in range(6)] == [0, -1, -1, -1, -1, -1]
    assert [got[i]["unlisted"] for i in range(6)] == [-1, -1, 1, -1, -1, -1]


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, label double, task string")
    said = spark.createDataFrame([], "doc_id long, quality int, toxic int, text string")
    assert L.judged(docs, said).collect() == []
    rows = [(i, t, "u", 1.0, 7, 3) for i, t, _ in texts(3, 40)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, task string, label double, toxic int, count int")
    assert L.judged(docs, said).count() == 43
    some = spark.createDataFrame([(i, 1, int(i % 5 == 0), "t", 2) for i in range(40)] + [(0, 0, 0, "t", 2), (None, 0, 1, "t", 2), (1, None, None, "t", 2)], "doc_id long, quality int, toxic int, text string, level int")
    assert L.judged(docs, some).count() == 43


def test_long_texts_are_read_whole():
    long = "stone " * 1_200_000 + "moron the the the"
    english = "the stone " * 700_000 + "moron"
    got = [dict(zip(L.VOTES, v)) for _, v, _ in L._analysed(pa.array([long, english, "a"]), L.NO_TERMS)]
    assert [g["nouns"] for g in got] == [-1, 0, -1]


def test_ties_and_repeats_give_the_same(spark):
    rows = texts(4, 90)
    said = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([r[:2] for r in rows] + [rows[0][:2]] * 2, "doc_id long, text string")
    one, two = (sorted(L.judged(d, said).collect()) for d in (docs, docs.repartition(5)))
    assert [(r.doc_id, r.kept) for r in one] == [(r.doc_id, r.kept) for r in two]
    assert np.allclose([r.clean_score for r in one], [r.clean_score for r in two])
