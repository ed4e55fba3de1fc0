"""Which shingles are counted for the order of the n-gram join."""

import numpy as np

from scriptorium.llm import ngram_join
from scriptorium.llm import words as W
from scriptorium.llm.shared import has_bit


def test_places_are_those_of_anchors():
    rng = np.random.default_rng(3)
    counts = np.array([200, 0, 5, 31, 32, 33, 1, 90])
    flat = rng.integers(0, 1 << 63, counts.sum()).astype(np.uint64) * np.uint64(2)
    ends = np.append(0, np.cumsum(counts))
    places = set(flat[ngram_join._places(flat, counts)].tolist())
    for a, b in zip(ends[:-1], ends[1:]):
        if b > a:
            assert set(ngram_join._anchors(flat[a:b]).tolist()) <= places
    assert not len(ngram_join._places(flat[:0], counts[:0]))


def test_what_stands_beside_a_wrong_bit_of_no_anchor_is_not_counted(spark):
    rng = np.random.default_rng(7)
    text = " ".join(f"w{n}" for n in rng.integers(0, 1 << 40, 2000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    data, offsets = W.texts(docs.select("text").toArrow().column(0).combine_chunks())
    flat = W.shingles(W.words(data, offsets)[2], ngram_join.K)
    table = np.zeros(1 << 20, np.uint64)
    place = flat[~np.isin(flat, ngram_join._anchors(flat))] >> np.uint64(64 - 26)
    np.bitwise_or.at(table, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    assert has_bit(table, flat.view(np.int64)).sum() > 1500
    assert ngram_join._beside(docs, spark.sparkContext.broadcast(table)).isEmpty()
    everything = np.full(1 << 14, (1 << 64) - 1, np.uint64)
    assert ngram_join._beside(docs, spark.sparkContext.broadcast(everything)).count() == len(np.unique(flat))
