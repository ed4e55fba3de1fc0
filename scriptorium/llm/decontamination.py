"""Benchmark decontamination: passages of documents within an edit distance of a benchmark item, in words.

A document leaks an item of n words if some passage of it is at most floor(n / 5) word edits from the item (fewer for
items under ten words, see `allowed`). Words are runs of letters and digits, lower-cased.

1. By the q-gram lemma, such a passage shares at least n - 2 - 3d word trigrams with the item. Places where fewer
   trigrams of items with n words lie close together start no window; this loses nothing.
2. Windows as long as the item are embedded by a random walk (CGK): the walk writes the word under its pointer and
   moves on by a random bit that depends on step and word, which turns edits into few Hamming differences.
3. Repeated bit sampling: each table hashes two steps of a walk. Windows that share a bucket with an item are
   candidates. The number of tables follows from TARGET, and from how often the walks of the items and of randomly
   edited copies with all allowed edits agree.
4. Candidates are verified by the exact edit distance between the item and the best passage around the window.

Items under LEAST words allow no edit: they are found where their words stand, by a look-up of hashed runs of words.

Cases: null or empty text leaks nothing; null item texts and items without a word are left out. Of equally close
passages the first counts. Equal items give a row each; texts are taken whole, whatever their length; repeated documents are all returned. Items go in blocks of BLOCK, each in a
scan of its own. An empty table on either side gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE, LEAST, BLOCK, TARGET, SAMPLED, WALKS = 0.2, 5, 20_000, 0.99, 2, 6
_WORD = re.compile(r"\w+")
OUT = "doc_id long, item_id long, distance int, item_words int, start int, end int"


def allowed(n: int) -> int:
    """Edits allowed for an item of n words; few enough that a shared trigram remains."""
    return min(int(SHARE * n), (n - 3) // 3)


def words(text: str) -> list[str]:
    found = _WORD.findall(text)
    return "\n".join(found).lower().split("\n") if found else []


def walks(rows: np.ndarray, seed: int) -> np.ndarray:
    """CGK embeddings of equally long rows of word ids: WALKS x rows x 2n; past the end a row goes on with -1."""
    n = rows.shape[1]
    rows = np.hstack([rows, np.full((len(rows), 1), -1)]).astype(np.int64)
    rng, each = np.random.default_rng([seed, n]), np.arange(len(rows))
    out = np.empty((WALKS, len(rows), 2 * n), np.int64)
    for w in range(WALKS):
        at = np.zeros(len(rows), np.int64)
        for step, (a, b) in enumerate(rng.integers(1, 1 << 40, (2 * n, 2)).tolist()):
            word = rows[each, at]
            out[w, :, step] = word
            at = np.minimum(at + ((word * (2 * a + 1) + b >> 33) & 1), n)
    return out


def runs(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes (63 bits) of all runs of n word ids along the last axis; -1 where a word is in no item."""
    size = max(0, ids.shape[-1] - n + 1)
    parts = [ids[..., k : k + size] for k in range(n)]
    code, known = np.zeros(parts[0].shape, np.uint64), np.ones(parts[0].shape, bool)
    for part in parts:
        known &= part > 0
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64)
    return np.where(known, (code & np.uint64((1 << 63) - 1)).astype(np.int64), -1)


class Index:
    """Items of one block, by length: trigrams, and buckets of sampled walk steps."""

    def __init__(self, items: list[tuple[int | None, list[str]]], seed: int = 11):
        self.seed, self.known, self.items, by = seed, {}, [], defaultdict(list)
        for item_id, ws in items:
            by[len(ws)].append(len(self.items))
            self.items.append((item_id, np.array([self.known.setdefault(w, len(self.known) + 1) for w in ws], np.int64)))
        self.lengths, self.short = {}, {}
        for n, own in by.items():
            if n < LEAST:
                at = self.short[n] = defaultdict(list)
                for i in own:
                    at[tuple(self.items[i][1].tolist())].append(i)
                continue
            rows = np.stack([self.items[i][1] for i in own])
            steps = self.tables(rows, n)
            embedded, buckets = walks(rows, seed), defaultdict(list)
            for t, (w, picks) in enumerate(steps):
                for i, key in zip(own, map(bytes, np.ascontiguousarray(embedded[w][:, picks]))):
                    buckets[t, key].append(i)
            self.lengths[n] = (np.unique(self.trigrams(rows)), steps, dict(buckets))
        self.all = np.unique(np.concatenate([x[0] for x in self.lengths.values()])) if self.lengths else np.zeros(0, np.int64)
        self.runs = {n: np.unique(runs(np.array(list(at), np.int64), n)) for n, at in self.short.items()}

    def trigrams(self, ids: np.ndarray) -> np.ndarray:
        return runs(ids, 3)

    def exact(self, ids: np.ndarray) -> dict[int, int]:
        """Of one text as word ids, the items under LEAST words that stand in it, each with its first place."""
        found = {}
        for n, own in self.runs.items():
            hashed = runs(ids, n)
            for s in np.flatnonzero(np.isin(hashed, own) & (hashed >= 0)).tolist():
                for item in self.short[n].get(tuple(ids[s : s + n].tolist()), ()):
                    found.setdefault(item, s)
        return found

    def tables(self, rows: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
        """Sampled steps of as many tables as TARGET needs at the largest distance."""
        rng = np.random.default_rng([self.seed, n, 5])
        some = rows[rng.integers(0, len(rows), 64)]
        edited = []
        for row in some:
            row = row.tolist()
            for _ in range(allowed(n)):
                at, kind = int(rng.integers(len(row))), int(rng.integers(4))
                row[at : at + (kind != 1)] = [] if kind == 0 else [-7 - len(row)]
            edited.append((row + [-3] * n)[:n])
        agree = float((walks(some, self.seed) == walks(np.array(edited), self.seed)).mean())
        tables = int(np.ceil(np.log(1 - TARGET) / np.log(1 - min(0.99, agree**SAMPLED))))
        return [(t % WALKS, np.sort(rng.choice(2 * n, SAMPLED, replace=False))) for t in range(tables)]

    def candidates(self, ids: np.ndarray) -> dict[int, set[int]]:
        """Of one text as word ids (0: in no item), by item the starts of windows that share a bucket with it."""
        found = defaultdict(set)
        tri = self.trigrams(ids)
        places = np.flatnonzero(tri >= 0)
        values = tri[places]
        for n, (own, steps, buckets) in self.lengths.items():
            d = allowed(n)
            need, span = n - 2 - 3 * d, n + d - 2
            p = places[own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values]
            if len(p) < need:
                continue
            tight = np.flatnonzero(p[need - 1 :] - p[: len(p) - need + 1] < span)
            if not len(tight):
                continue
            starts = np.unique(np.concatenate([np.arange(max(0, p[i + need - 1] - span + 1), p[i] + 1) for i in tight]))
            padded = np.concatenate([ids, np.zeros(n, np.int64)])
            for lo in range(0, len(starts), 4096):
                some = starts[lo : lo + 4096]
                embedded = walks(padded[some[:, None] + np.arange(n)], self.seed)
                for t, (w, picks) in enumerate(steps):
                    for s, key in zip(some.tolist(), map(bytes, np.ascontiguousarray(embedded[w][:, picks]))):
                        for item in buckets.get((t, key), ()):
                            found[item].add(s)
        return found

    def verified(self, item: int, ids: list[int], starts: set[int]) -> tuple[int, int, int] | None:
        """Distance, first and last word of the closest passage near the windows, if it is close enough."""
        pattern = self.items[item][1].tolist()
        n, d, best = len(pattern), allowed(len(pattern)), None
        regions: list[list[int]] = []
        for s in sorted(starts):
            lo, hi = max(0, s - 2 * d), min(len(ids), s + n + 2 * d)
            if regions and lo <= regions[-1][1]:
                regions[-1][1] = hi
            else:
                regions.append([lo, hi])
        for lo, hi in regions:
            column = [(i, lo) for i in range(n + 1)]
            for at in range(lo, hi):
                word = ids[at]
                new = [(0, at + 1)]
                for i, p in enumerate(pattern):
                    x, y = column[i], min(column[i + 1], new[i])
                    new.append(min(x if p == word else (x[0] + 1, x[1]), (y[0] + 1, y[1])))
                column = new
                if column[n][0] <= d and (best is None or column[n][0] < best[0]):
                    best = (column[n][0], column[n][1], at + 1)
        return best


def _block(docs: DataFrame, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)  # at most BLOCK items

    def run(batches):
        index = shared.value
        get, all_ = index.known.get, index.all
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ws = words(text or "")
                if not ws:
                    continue
                ids = np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))
                best = {item: (0, s, s + len(index.items[item][1])) for item, s in index.exact(ids).items()}
                tri = index.trigrams(ids)
                tri = tri[tri >= 0]
                if len(tri) and len(all_) and (all_[np.minimum(np.searchsorted(all_, tri), len(all_) - 1)] == tri).any():
                    for item, starts in index.candidates(ids).items():
                        best[item] = index.verified(item, ids.tolist(), starts)
                spans = [m.span() for m in _WORD.finditer(text)] if any(best.values()) else []
                for item, b in best.items():
                    if b:
                        rows.append({"doc_id": doc, "item_id": index.items[item][0], "distance": b[0], "item_words": len(index.items[item][1]), "start": spans[b[1]][0], "end": spans[b[2] - 1][1]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("item_words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, OUT)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document of docs (doc_id, text) and item of benchmark (item_id, text) that it leaks: doc_id,
    item_id, distance, item_words, and the code points start and end of the closest passage."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    blocks, out = max(1, -(-items.count() // BLOCK)), None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        rows = sorted(((r["item_id"], words(r["text"])) for r in rows), key=lambda r: (r[0] is None, r[0], r[1]))
        rows = [r for r in rows if r[1]]
        one = _block(docs, Index(rows)) if rows else docs.sparkSession.createDataFrame([], OUT)
        out = one if out is None else out.unionByName(one)
    return out
