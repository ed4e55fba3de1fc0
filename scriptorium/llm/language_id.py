"""Language identification in two steps: the language family, then one-versus-one linear SVMs inside the family.

Features are counts of character bigrams and trigrams of the lower-cased letters (all else is a space), hashed to DIMS
buckets and divided by the number of n-grams of the text, so that a text of any length is scored whole in one pass.
The machines are fitted by dual coordinate descent on a sample of about SAMPLE labelled rows, drawn evenly from all
languages by a hash of doc_id (EACH for a language at least, however many there are); everything else covers all rows.

Cases: null text, or text without a letter: `und` with score 0. Null lang: not learned from, but predicted. Null
doc_id: not learned from. No labelled row at all: `und` for every text. Repeated rows are all returned. Languages that
the family table does not know are families of their own. Columns of the input that have the names of the new ones are
replaced. Equal margins go to the language that comes first in the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "semitic": ["ar", "he", "mt"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

DIMS, SAMPLE, EACH, EPOCHS, COST, SCALE = 1 << 14, 3000, 10, 30, 10.0, 32.0
CHUNK = 1 << 19


def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space."""
    if not _TABLE:
        table = np.full(0x110000, 32, np.uint32)
        letters = [c for c in range(0x110000) if chr(c).isalpha()]
        table[letters] = letters
        _TABLE.append(table)
    return _TABLE[0]


_TABLE: list[np.ndarray] = []


def grams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunks of rows lo to hi: buckets of all n-grams, the place of each row's first one, and whether it has letters."""
    row = 0
    while row < len(texts):
        lo, size = row, 0
        while row < len(texts) and (row == lo or size + len(texts[row] or "") <= CHUNK):
            size += len(texts[row] or "")
            row += 1
        parts = [(t or "").lower() for t in texts[lo:row]]
        points = _letters()[np.frombuffer((" " + "  ".join(parts) + "  ").encode("utf-32-le", "replace"), np.uint32)]
        starts = np.cumsum([0, *(len(t) + 2 for t in parts[:-1])]).astype(np.int64)
        a, b, c = points[:-2], points[1:-1], points[2:]
        p = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
        two = ((p ^ (p >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 14)
        p += c * np.uint32(0xC2B2AE3D) + np.uint32(77)
        three = ((p ^ (p >> np.uint32(15))) * np.uint32(0x297A2D39)) >> np.uint32(32 - 14)
        useful = (b != 32) | ((a != 32) & (c != 32))
        yield lo, row, np.stack([two, three]), starts, useful


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(values) else np.zeros(len(starts))


def features(docs: DataFrame) -> DataFrame:
    """lang, ids, counts of the n-grams of each row of docs (lang, text)."""

    def run(batches):
        for batch in batches:
            ids, counts = [], []
            for lo, hi, hashed, starts, useful in grams(batch.column("text").to_pylist()):
                for x, y in zip(starts, [*starts[1:], hashed.shape[1]]):
                    u, n = np.unique(hashed[:, x:y][:, useful[x:y]], return_counts=True)
                    ids.append(u.astype(np.int32))
                    counts.append(n.astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))], ["lang", "ids", "counts"])

    return docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, "lang string, ids array<int>, counts array<float>")


def svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised linear SVM with squared hinge loss, by dual coordinate descent."""
    w, bias, alpha = np.zeros(DIMS), 0.0, np.zeros(len(rows))
    weight = COST / np.where(sign > 0, max(1, (sign > 0).sum()), max(1, (sign < 0).sum())) * len(rows) / 2
    norm = np.array([v @ v + 1 for _, v in rows]) + 0.5 / weight
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, v = rows[i]
            step = max(alpha[i] - (sign[i] * (w[ids] @ v + bias) - 1 + alpha[i] * 0.5 / weight[i]) / norm[i], 0) - alpha[i]
            if step:
                alpha[i] += step
                w[ids] += step * sign[i] * v
                bias += step * sign[i]
    return w, bias


def fit(docs: DataFrame) -> dict:
    """The machines, from docs (doc_id, text, lang): all its rows with a lang may be learned from."""
    known = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return {"langs": []}
    each = max(EACH, SAMPLE // len(counts))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, each / n)))
    rows = features(known.where(drawn < F.element_at(share, F.col("lang")))).limit(2 * each * len(counts)).collect()
    rows = [(r["lang"], np.array(r["ids"], np.int32), np.array(r["counts"], np.float64)) for r in rows if r["ids"]]
    rows = sorted(((lang, ids, SCALE * c / c.sum()) for lang, ids, c in rows), key=lambda r: (r[0], len(r[1]), r[1].tolist()))
    langs = sorted({r[0] for r in rows})
    if not langs:
        return {"langs": []}
    family = np.array([FAMILY_OF.get(x, x) for x in langs])
    families, x = sorted(set(family)), [r[1:] for r in rows]
    of = np.array([langs.index(r[0]) for r in rows])
    first = [svm(x, np.where(family[of] == f, 1, -1)) for f in families] if len(families) > 1 else []
    pairs = [(i, j) for i in range(len(langs)) for j in range(i + 1, len(langs)) if family[i] == family[j]]
    second = []
    for i, j in pairs:
        own = np.flatnonzero((of == i) | (of == j))
        second.append(svm([x[k] for k in own], np.where(of[own] == i, 1, -1)))
    machines = first + second
    return {
        "langs": langs,
        "family": np.array([families.index(f) for f in family]),
        "families": len(families),
        "pairs": pairs,
        "w": np.stack([m[0] for m in machines]).astype(np.float32) if machines else np.zeros((0, DIMS), np.float32),
        "b": np.array([m[1] for m in machines]),
    }


def decide(margins: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """The language (place in langs) and confidence of each row of margins."""
    n, many = len(margins), model["families"] if model["families"] > 1 else 0
    squash = lambda m: 1 / (1 + np.exp(-3 * np.clip(m, -9, 9)))
    if many:
        best = np.argmax(margins[:, :many], 1)
        top2 = np.partition(margins[:, :many], -2, 1)
        sure = squash((top2[:, -1] - top2[:, -2]) / 2)
    else:
        best, sure = np.zeros(n, np.int64), np.ones(n)
    votes = np.zeros((n, len(model["langs"])))
    for k, (i, j) in enumerate(model["pairs"]):
        p = squash(margins[:, many + k])
        votes[:, i] += p
        votes[:, j] += 1 - p
    members = model["family"][None, :] == best[:, None]
    votes = np.where(members, votes, -1)
    lang, size = np.argmax(votes, 1), members.sum(1)
    return lang, sure * np.where(size > 1, votes.max(1) / np.maximum(size - 1, 1), 1)


def with_language(docs: DataFrame, model: dict, lang: str = "lang_pred", score: str = "score", text: str = "text") -> DataFrame:
    """docs with two more columns: the predicted language and its score from 0 to 1. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 64 KB a machine; grows with the languages, not with the rows
    docs = docs.drop(lang, score)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches):
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            name, sure = np.full(n, "und", object), np.zeros(n)
            if m["langs"]:
                for lo, hi, hashed, starts, useful in grams(batch.column(batch.schema.get_field_index(text)).to_pylist()):
                    total = 2.0 * _sums(useful.astype(np.float32), starts)
                    flat = [np.where(useful, w[hashed[0]] + w[hashed[1]], np.float32(0)) for w in m["w"]]
                    margins = np.stack([SCALE * _sums(v.astype(np.float64), starts) for v in flat], 1) if flat else np.zeros((hi - lo, 0))
                    got, p = decide(margins / np.maximum(total, 1)[:, None] + m["b"], m)
                    some = total > 0
                    name[lo:hi] = np.where(some, np.array(m["langs"], object)[got], "und")
                    sure[lo:hi] = np.where(some, p, 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name.tolist(), pa.string()), pa.array(sure, pa.float64())], names=[*batch.schema.names, lang, score])

    return docs.mapInArrow(run, schema)


def fold(of: int, column: str = "doc_id"):
    """crc32 of an id as text, modulo a number; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(of))
