"""Quality classifier from weak labels.

Labellers vote 1 (good), 0 (bad) or abstain on each text, from its counts, a word list, or a table of annotations,
which is one labeller among others. Most heuristics see one defect each and vote 0 or abstain; `plain` and `unlisted`
vote 1 where none is in sight. The lists are English; terms of abuse in other languages are learned from the annotated
texts (see learned_terms), and `unlisted` abstains where neither covers a text. Expectation-maximisation over the counts of all vote patterns (at most 3 to the
power of the labellers) estimates each labeller's accuracy and how often it votes for good and for bad texts; the
posterior of a pattern is the label of its texts. A logistic scorer over hashed features (words, heads of words, and
steps of the counts; each once per text; those whose share differs between the labels by over Z deviations) is fitted to the posteriors of a sample of at most SAMPLE texts, drawn by a
hash from texts whose posterior leans either way, and scores every whole text. There are two tasks: quality, and
freedom from abuse; a text is kept if it passes both.

Cases: null and empty texts have no words: the vote that needs words abstains, and the text is scored by its counts.
Null doc_id: no annotation, scored all the same. Several annotations of a document count as the worst. Repeated rows
are all returned. With no text there is nothing to fit: no rows. Texts are read whole, however long, a chunk at a time.
Ties: of terms that tell equally much the smaller hash and level go first; a score of exactly a half passes. Columns
other than doc_id and text (of annotations: doc_id, quality, toxic) are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import words as W
from scriptorium.llm.shared import bit_table, has_bit, keep, small_or_shuffled

DIMS, SAMPLE, EPOCHS, RATE, Z, STEPS = 1 << 18, 12_000, 30, 1.0, 6.0, 40
#: Terms are learned from at most about ANNOTATED texts of either label, drawn by a hash; at most TERMS, the most telling, are kept.
ANNOTATED, TERMS, GAIN, PRECISION = 20_000, 4_096, 25.0, 0.9
#: A text holds a term at a level if so many of 1,000 words are it.
RATES = np.array([0, 2, 8, 32])
#: Common English words of abuse, nouns and others, for the two list labellers, and plain words that show the language.
NOUNS = ["clown", "creep", "fool", "idiot", "jerk", "liar", "loser", "moron", "pig", "scum", "trash", "vermin"]
OTHERS = ["despicable", "disgusting", "dumb", "hateful", "pathetic", "repulsive", "stupid", "ugly", "vile", "worthless"]
PLAIN = ["a", "and", "are", "for", "in", "is", "of", "on", "that", "the", "to", "with"]
TASKS = {"quality": ("symbols", "capitals", "repeats", "lengths", "marks", "plain", "annotated_quality"), "clean": ("nouns", "others", "learned", "unlisted", "annotated_clean")}
VOTES = [v for vs in TASKS.values() for v in vs if not v.startswith("annotated")]

_UPPER, _SYMBOL, _MARK = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_SYMBOL[list(b"#*$%&|<>{}~^=_\\")] = True
_MARK[list(b"!?")] = True


def _hash_of(listed: list[str]) -> np.ndarray:
    data = "\n".join(listed).encode()
    return W.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[2]


def _split(data: np.ndarray, offsets: np.ndarray):
    """Words of a chunk of texts: starts, ends, places of each text's first word, and by word the hashes of its first four and six bytes and of itself without marks at its end."""
    starts, ends, hashes, at = W.words(data, offsets)
    bare = ends - (np.isin(data[np.maximum(ends - 1, 0)], np.frombuffer(b".,;:!?", np.uint8)) & (ends - starts > 1))
    heads, short = np.zeros(len(starts), np.uint64), None
    for k in range(6):
        inside = starts + k < bare
        heads[inside] |= W.LOWER[data[starts[inside] + k]].astype(np.uint64) << np.uint64(8 * k)
        if k == 3:
            short = W.mix(heads + np.uint64(0x1234567))
    trimmed = hashes.copy()
    odd = np.flatnonzero(bare != ends)
    if len(odd):
        lengths = bare[odd] - starts[odd]
        cuts = np.append(0, np.cumsum(lengths))
        flat = np.repeat(starts[odd] - cuts[:-1], lengths) + np.arange(cuts[-1])
        trimmed[odd] = W.words(data[flat], cuts)[2]
    return starts, ends, at, short, W.mix(heads + np.uint64(0x7654321)), trimmed


def _keyed(terms: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return W.mix(terms + levels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _level(counts: np.ndarray, words: int) -> np.ndarray:
    return np.searchsorted(RATES, 1000 * counts / max(words, 1), "right") - 1


def _terms(column: pa.Array):
    """By text: its different terms (words, heads of four and six bytes), the level of each, and a hash of the words beside its first place."""
    data, offsets = W.texts(column)
    for lo, hi in W.chunks(offsets):
        _, _, at, *kinds, words = _split(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        for i in range(hi - lo):
            w = words[at[i] : at[i + 1]]
            beside = W.mix(np.append(np.uint64(1), w)[: len(w)] ^ W.mix(np.append(w, np.uint64(2))[1:]))
            found = [np.unique(h, return_index=True, return_counts=True) for h in (*(k[at[i] : at[i + 1]] for k in kinds), w)]
            terms, first, counts = (np.concatenate(x) for x in zip(*found))
            yield lo + i, terms, _level(counts, len(w)), beside[first]


def learned_terms(docs: DataFrame, annotations: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Terms of abuse, and terms with their levels, as sorted hashes: those far more frequent in texts annotated as toxic.

    A term at a level counts for the toxic texts once for each pair of words beside it, so that copies of one text count
    once; for the others by text. It is kept if at least PRECISION of the texts that hold it are toxic and its
    count times the logarithm of the ratio of its shares is at least GAIN; of these the TERMS with the highest.
    """
    drawn = annotations.groupBy("toxic").count().collect()  # two rows
    sizes = {r["toxic"]: min(r["count"], ANNOTATED) for r in drawn}
    each = {r["toxic"]: max(r["count"] / ANNOTATED, 1.0) for r in drawn}
    ratio = F.lit(0.0)
    for r in drawn:
        ratio = F.when(F.col("toxic") == r["toxic"], ANNOTATED / r["count"]).otherwise(ratio)
    some = keep(annotations.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < ratio), "annotated")

    def held(toxic: int, table: np.ndarray | None = None) -> DataFrame:
        """Terms (of a table's) of the texts with a label: term, level, beside for each place told apart, and how often in a batch."""

        def run(batches):
            for batch in batches:
                found = [(t, v, s) if table is None else (t[m], v[m], np.zeros(int(m.sum()), np.uint64)) for _, t, v, s in _terms(batch.column("text")) for m in [None if table is None else has_bit(table, t)]]
                if not found:
                    continue
                rows = np.stack([np.concatenate(x).astype(np.uint64) for x in zip(*found)])
                order = np.lexsort(rows)
                rows = rows[:, order]
                first = np.flatnonzero(np.append(True, (rows[:, 1:] != rows[:, :-1]).any(0))[: rows.shape[1]])
                counts = np.diff(np.append(first, rows.shape[1]))
                term, level, beside = rows[:, first]
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(level.astype(np.int32)), pa.array(beside.view(np.int64)), pa.array(counts)], ["term", "level", "beside", "count"])

        texts = docs.join(small_or_shuffled(some.where(F.col("toxic") == toxic).select("doc_id")), "doc_id").select("text")
        return texts.mapInArrow(run, "term long, level int, beside long, count long")

    every = F.explode(F.sequence(F.lit(0), F.col("level"))).alias("level")  # a text holds a term at all lower levels too
    t, n = sizes.get(1, 0), sizes.get(0, 0)
    gain = lambda others: F.col("t") * F.log(F.col("t") * float(n + 1) / ((others + 1) * float(t + 1)))
    telling = held(1).groupBy("term", "beside").agg(F.max("level").alias("level")).select("term", every).groupBy("term", "level").agg(F.count("*").alias("t"))
    telling = keep(telling.where(gain(F.lit(0)) >= GAIN), "telling")
    others = held(0, bit_table(telling, "term")).groupBy("term", "level").agg(F.sum("count").alias("n")).select("term", every, "n").groupBy("term", "level").agg(F.sum("n").alias("n"))
    told = telling.join(others, ["term", "level"], "left").fillna(0, ["n"])
    told = told.where(F.col("t") * each.get(1, 1.0) * (1 - PRECISION) >= F.col("n") * each.get(0, 1.0) * PRECISION).withColumn("gain", gain(F.col("n"))).where(F.col("gain") >= GAIN)
    got = told.orderBy(F.desc("gain"), "term", "level").limit(TERMS).select("term", "level").toArrow()
    terms = got["term"].to_numpy().view(np.uint64)
    return np.unique(terms), np.unique(_keyed(terms, got["level"].to_numpy()))


def _analysed(column: pa.Array, learned: tuple[np.ndarray, np.ndarray]):
    """By text: its votes (1, 0, -1 for none), in the order of VOTES, and its hashed features."""
    lists = [_hash_of(NOUNS), _hash_of(OTHERS), _hash_of(PLAIN)]
    known, keys = learned
    likely = np.zeros(1 << 16, bool)
    likely[known & np.uint64(0xFFFF)] = True
    data, offsets = W.texts(column)
    for lo, hi in W.chunks(offsets):
        part = data[offsets[lo] : offsets[hi]]
        starts, ends, at, heads, longer, trimmed = _split(part, offsets[lo : hi + 1] - offsets[lo])
        counted = [np.append(0, np.cumsum(np.isin(trimmed, one))) for one in lists]
        # places of learned terms, in the order of the texts
        spots, terms = [], []
        for kind in (heads, longer, trimmed):
            place = np.flatnonzero(likely[kind & np.uint64(0xFFFF)])
            place = place[np.isin(kind[place], known)]
            spots.append(place)
            terms.append(kind[place])
        spots, terms = np.concatenate(spots), np.concatenate(terms)
        order = np.argsort(spots, kind="stable")
        spots, terms = spots[order], terms[order]
        bounds = np.searchsorted(spots, at)
        upper, symbol, mark = (np.append(0, np.cumsum(t[part])) for t in (_UPPER, _SYMBOL, _MARK))
        letters = np.append(0, np.cumsum((W.LOWER[part] >= 97) & (W.LOWER[part] <= 122)))
        for i in range(hi - lo):
            a, b = offsets[lo + i] - offsets[lo], offsets[lo + i + 1] - offsets[lo]
            w, n = trimmed[at[i] : at[i + 1]], at[i + 1] - at[i]
            distinct = np.unique(w)
            size = max(n, 1)
            shares = (
                (symbol[b] - symbol[a]) / size,
                (upper[b] - upper[a]) / max(letters[b] - letters[a], 1),
                1 - len(distinct) / (size / (1 + size / 2000)),
                np.log((ends[at[i] : at[i + 1]] - starts[at[i] : at[i + 1]]).sum() / size + 1),
                (mark[b] - mark[a]) / size,
            )
            symbols, capitals, repeats, length, marks = shares
            bad = np.array([symbols > 0.3, capitals > 0.5, repeats > 0.7, not 1.2 < length < 2.6, marks > 0.3]) & (n >= 20)
            odd = np.array([symbols > 0.05, capitals > 0.15, repeats > 0.5, not 1.5 < length < 2.3, marks > 0.1])
            nouns, others, plain = (int(c[at[i + 1]] - c[at[i]]) for c in counted)
            held = np.zeros(0, np.uint64)
            if bounds[i] < bounds[i + 1]:
                held, counts = np.unique(terms[bounds[i] : bounds[i + 1]], return_counts=True)
                levels = _level(counts, n)
                held = np.concatenate([_keyed(held[levels >= k], np.full(int((levels >= k).sum()), k)) for k in range(len(RATES))])
                held = held[np.isin(held, keys)]
            english = 20 * plain >= n  # elsewhere the listed words may be other words
            covered = len(known) > 0 or english
            hits = [english and nouns > 0, english and others > 0, len(held) > 0]
            votes = [*np.where(bad, 0, -1).tolist(), 1 if n >= 20 and not odd.any() else -1, *(0 if h else -1 for h in hits), 1 if n and covered and not any(hits) else -1]
            levels = W.mix(np.array([(k + 1) * 1000 + int(np.clip(8 * x, -1, 99)) for k, x in enumerate(shares)], np.uint64))
            yield lo + i, votes, np.unique(np.concatenate([distinct, np.unique(heads[at[i] : at[i + 1]]), levels, held]) & np.uint64(DIMS - 1)).astype(np.int32)


NO_TERMS = np.zeros(0, np.uint64), np.zeros(0, np.uint64)


def votes(docs: DataFrame, learned: tuple[np.ndarray, np.ndarray] = NO_TERMS) -> DataFrame:
    """doc_id and the vote of each heuristic labeller."""

    def run(batches):
        for batch in batches:
            rows = np.array([v for _, v, _ in _analysed(batch.column("text"), learned)], np.int8).reshape(batch.num_rows, len(VOTES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(rows[:, k]) for k in range(len(VOTES)))], ["doc_id", *VOTES])

    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{v} byte" for v in VOTES))


def posteriors(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns (rows of 1, 0, -1): the posterior of label 1 for each, and table[labeller, label, vote]."""
    voted = patterns >= 0
    share = (patterns == 1).sum(1) / np.maximum(voted.sum(1), 1)
    q = np.where(voted.any(1), 0.1 + 0.8 * (share > 0.75), 0.5)
    n = patterns.shape[1]
    table = np.zeros((n, 2, 3))
    for _ in range(STEPS):
        weight = np.stack([counts * (1 - q), counts * q])
        prior = (weight.sum(1) + 1) / (counts.sum() + 2)
        for k in range(n):
            for label in (0, 1):
                for vote in (-1, 0, 1):
                    table[k, label, vote + 1] = weight[label][patterns[:, k] == vote].sum() + 1 + (2 if vote == label else 0)
            table[k] /= table[k].sum(1, keepdims=True)
        # that a labeller abstains tells nothing about the label
        use = np.where(np.arange(3)[None, None] == 0, 1.0, table)
        log = np.stack([np.log(prior[label]) + sum(np.log(use[k, label, patterns[:, k] + 1]) for k in range(n)) for label in (0, 1)])
        q = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return q, table


def fit_scorer(rows: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer over sets of hashed features with soft labels (AdaGrad)."""
    w, g, bias, gb = np.zeros(DIMS, np.float32), np.full(DIMS, 1.0, np.float32), 0.0, 1.0
    rng = np.random.default_rng(3)
    if not rows:
        return w, bias
    total = sum(y for _, y in rows)
    n1, n0 = max(total, 1e-6), max(len(rows) - total, 1e-6)
    seen, good = np.zeros(DIMS), np.zeros(DIMS)
    for ids, y in rows:
        seen[ids] += 1
        good[ids] += y
    p = (seen + 1) / (len(rows) + 2)
    telling = np.abs(good / n1 - (seen - good) / n0) > Z * np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    rows = [(ids[telling[ids]], y) for ids, y in rows]
    weight = (len(rows) / 2 / max(len(rows) - total, 1e-6), len(rows) / 2 / max(total, 1e-6))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, y = rows[i]
            p = 1 / (1 + np.exp(-np.clip(w[ids].sum() + bias, -30, 30)))
            d = float((p - y) * min(10, y * weight[1] + (1 - y) * weight[0]))
            g[ids] += d * d
            w[ids] -= RATE * d / np.sqrt(g[ids])
            gb += d * d
            bias -= RATE * d / gb**0.5
    return w, bias


def judged(docs: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text) as doc_id, quality_score, clean_score, kept.

    annotations (doc_id, quality, toxic) may cover any part of the documents.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learned = NO_TERMS
    if annotations is not None:
        said = annotations.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("annotated_quality"), F.max(F.col("toxic").cast("int")).alias("toxic"))
        learned = learned_terms(docs, said.where("toxic IN (0, 1)").select("doc_id", "toxic"))
    own = votes(docs, learned)
    if annotations is None:
        own = own.withColumns({"annotated_quality": F.lit(-1), "annotated_clean": F.lit(-1)})
    else:
        own = own.join(said.withColumn("annotated_clean", 1 - F.col("toxic")).drop("toxic"), "doc_id", "left").fillna(-1, ["annotated_quality", "annotated_clean"])
    own = keep(own, "votes")
    priors, sample = {}, None
    for task, names in TASKS.items():
        got = own.groupBy(*names).count().collect()  # at most 3 ** 7 patterns of 7 labellers
        patterns = np.array([[r[v] for v in names] for r in got], np.int64).reshape(-1, len(names))
        q, _ = posteriors(patterns, np.array([r["count"] for r in got], float))
        mapped = own.sparkSession.createDataFrame([(*p, x) for p, x in zip(patterns.tolist(), q.tolist())], ", ".join(f"{v} int" for v in names) + ", label double")
        labelled = own.join(F.broadcast(mapped), list(names)).where("abs(label - 0.5) > 0.3 AND doc_id IS NOT NULL").select("doc_id", "label")
        sizes = {r["good"]: r["count"] for r in labelled.groupBy((F.col("label") > 0.5).alias("good")).count().collect()}
        priors[task] = float(np.log((sizes.get(True, 0) + 1) / (sizes.get(False, 0) + 1)))
        ratio = F.when(F.col("label") > 0.5, SAMPLE / 4 / max(sizes.get(True, 0), 1)).otherwise(SAMPLE / 4 / max(sizes.get(False, 0), 1))
        drawn = F.pmod(F.xxhash64("doc_id", F.lit(task)), F.lit(1 << 30)) / float(1 << 30)
        one = labelled.where(drawn < ratio).select("doc_id", F.lit(task).alias("task"), "label")
        sample = one if sample is None else sample.unionByName(one)
    sample = keep(sample, "sample").limit(2 * SAMPLE)

    def features(batches):
        for batch in batches:
            ids = [f for _, _, f in _analysed(batch.column("text"), learned)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("task"), batch.column("label"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "task", "label", "ids"])

    got = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "task", "label", "text").mapInArrow(features, "doc_id long, task string, label double, ids array<int>").toArrow()
    rows = sorted(zip(got["task"].to_pylist(), got["doc_id"].to_pylist(), got["label"].to_pylist(), (x.values.to_numpy() for x in got["ids"])), key=lambda r: (r[0], r[1], len(r[3])))
    fitted = {}
    for task in TASKS:
        w, bias = fit_scorer([(ids, label) for of, _, label, ids in rows if of == task])
        fitted[task] = w, bias + priors[task]  # the sample has both labels in equal parts, the texts don't
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # two vectors of DIMS weights

    def score(batches):
        models = shared.value
        for batch in batches:
            out = np.zeros((len(TASKS), batch.num_rows))
            seen = np.zeros((batch.num_rows, len(VOTES)), np.int64)
            for i, v, ids in _analysed(batch.column("text"), learned):
                seen[i] = v
                for t, task in enumerate(TASKS):
                    w, bias = models[task]
                    out[t, i] = 1 / (1 + np.exp(-np.clip(float(w[ids].sum()) + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in out)], ["doc_id", "quality_score", "clean_score"])

    scored = docs.mapInArrow(score, "doc_id long, quality_score double, clean_score double")
    return scored.withColumn("kept", (F.col("quality_score") >= 0.5) & (F.col("clean_score") >= 0.5))
