"""Ranked lexical search in which documents that look alike to the queries are scored once.

A document is restricted to the vocabulary of the items. Documents with the same terms, as often each, and the same
length norm are a class: rows are dealt by the hash of these three, and the aggregation compares them whole, so a hash
in common is not enough. Each class is scored once against all items, in integers; the best classes of an item, by score
and then by smallest doc_id, are expanded into their members, by ascending doc_id. A class after the k-th has no member
among an item's k best, so the result is exact.

Terms are maximal runs of ASCII letters, digits and all other than ASCII; only A-Z are lower-cased. Whole texts are read.
Items are searched in blocks of about BLOCK_BYTES of vocabulary and postings, which travel with the tasks; any number of
blocks works, each with a pass over the documents.

Cases: null or empty texts have no term and don't count as documents. Every row is a document of its own, rows that
repeat a doc_id too; a null doc_id comes after all others. Rows that repeat an item_id are one item, with the terms of
all its texts; a null item_id is an item. Equal scores go by doc_id. Empty tables give no rows. Other columns are unused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.shared import keep, small_or_shuffled
from scriptorium.llm.words import LOWER, chunks, texts

TOP = 20
#: Vocabulary and postings of a block of items that every task holds.
BLOCK_BYTES = 8 << 20
#: Scores (8 bytes each) that a task holds at a time, and bytes of text that it splits at a time.
CELLS, SPLIT = 1 << 21, 4 << 20
LAST = (1 << 63) - 1

IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, pa.Array]]:
    """By chunks: first row, row after the last, the row of each term counted from the first, and the terms."""
    data, offsets = texts(column)
    for lo, hi in chunks(offsets, SPLIT):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        inside = IN_TERM[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begin = at[:-1][at[:-1] < len(part)]
        first[begin] = inside[begin]
        starts = np.flatnonzero(first)
        kept = LOWER[part[inside]]
        ends = np.append(np.cumsum(inside)[starts] - 1, len(kept)).astype(np.int64)
        found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(kept))
        yield lo, hi, np.searchsorted(at, starts, "right") - 1, found


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times: the terms of each item with their repeats."""

    def run(batches):
        for batch in batches:
            ids = batch.column("item_id")
            for lo, _, row, found in terms(batch.column("text")):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + lo)), found.cast(pa.string())], names=["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    split = items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"item_id {kind}, term string")
    return split.groupBy("item_id", "term").agg(F.count("*").alias("times"))


def bags(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """doc_id, n, terms, tfs: a document's terms with repeats, and its places in the vocabulary, ascending, with counts."""

    def run(batches):
        for batch in batches:
            ids, size = batch.column("doc_id"), max(len(vocabulary), 1)
            for lo, hi, row, found in terms(batch.column("text")):
                known = pc.index_in(found, value_set=vocabulary)
                known = pc.fill_null(known, -1).to_numpy(zero_copy_only=False).astype(np.int64)
                keys, tfs = np.unique((row * size + known)[known >= 0], return_counts=True)
                ends = pa.array(np.searchsorted(keys, np.arange(hi - lo + 1) * size).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((keys % size).astype(np.int32), tfs.astype(np.int64))]
                n = pa.array(np.bincount(row, minlength=hi - lo).astype(np.int64))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), n, *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def best_classes(classes: DataFrame, postings: list[tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """item, score, first_doc, class_id: the k best classes of each item among those of a task."""
    n = 1 + max((int(at.max()) for at, _ in postings if len(at)), default=-1)

    def run(batches):
        best = [tuple(np.zeros(0, np.int64) for _ in range(3)) for _ in range(n)]
        for batch in batches:
            step = max(1, CELLS // max(n, 1))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                m, first, number = (part.column(c).to_numpy(zero_copy_only=False) for c in ("m", "first_doc", "class_id"))
                sizes = pc.list_value_length(part.column("terms")).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), sizes)
                at, tf = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tfs"))
                gain = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
                scores = np.zeros((part.num_rows, n), np.int64)
                order = np.argsort(at, kind="stable")
                cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
                for begin, end in zip(cuts, np.append(cuts[1:], len(order))):
                    some = order[begin:end]
                    items, weights = postings[at[some[0]]]
                    scores[row[some][:, None], items] += gain[some][:, None] * weights
                for item in range(n):
                    score, docs, ids = best[item]
                    more = np.flatnonzero(scores[:, item] >= (score[-1] if len(score) == k else 1))
                    if len(more):
                        score, docs, ids = np.append(score, scores[more, item]), np.append(docs, first[more]), np.append(ids, number[more])
                        top = np.lexsort((ids, docs, -score))[:k]
                        best[item] = score[top], docs[top], ids[top]
        found = [np.concatenate([x[i] for x in best] or [np.zeros(0, np.int64)]) for i in range(3)]
        item = np.repeat(np.arange(n, dtype=np.int64), [len(x[0]) for x in best])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (item, *found)], names=["item", "score", "first_doc", "class_id"])

    return classes.select("m", "first_doc", "class_id", "terms", "tfs").mapInArrow(run, "item long, score long, first_doc long, class_id long")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of each item (item_id, text)."""
    split = keep(item_terms(items), "item-terms")
    size = split.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0
    count = 1 + size // block_bytes
    split = split.withColumn("block", F.pmod(F.xxhash64(F.to_json(F.struct("item_id"))), F.lit(count)))
    done = [_block(docs, split.where(F.col("block") == b).drop("block"), k) for b in range(count)]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _block(docs: DataFrame, split: DataFrame, k: int) -> DataFrame:
    spark, kind = docs.sparkSession, split.schema["item_id"].dataType.simpleString()
    held = split.toArrow().combine_chunks()  # bounded by block_bytes, but for a larger item alone
    ids = held.column("item_id").combine_chunks().dictionary_encode("encode")
    words = held.column("term").combine_chunks().cast(pa.large_string()).dictionary_encode()
    bag = keep(bags(docs, words.dictionary), "bags")
    totals = bag.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    empty = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    if not totals[0] or not len(words):
        return empty
    # the product may leave 64 bits in very large tables
    norm = F.expr(f"75L + CAST((CAST(25 * n AS DECIMAL(20, 0)) * {totals[0]}BD) div {totals[1]}BD AS BIGINT)")
    bag = bag.where(F.size("terms") > 0).select("doc_id", norm.alias("m"), "terms", "tfs")
    classes = bag.groupBy("m", "terms", "tfs").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("first_doc"), F.count("*").alias("members"))
    classes = keep(classes.withColumn("class_id", F.monotonically_increasing_id()), "classes")
    df = np.zeros(len(words.dictionary), np.int64)
    for row in classes.select(F.explode("terms").alias("term"), "members").groupBy("term").agg(F.sum("members").alias("df")).collect():
        df[row["term"]] = row["df"]
    weight = np.floor(1000 * np.log((2 * totals[0] + 2) / (2 * df + 1))).astype(np.int64)

    at, item, times = words.indices.to_numpy(), ids.indices.to_numpy(), held.column("times").to_numpy()
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(len(df) + 1))
    postings = [(item[s], weight[t] * times[s]) for t, s in ((t, order[cuts[t] : cuts[t + 1]]) for t in range(len(df)))]
    best = best_classes(classes, postings, k)
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), "first_doc", "class_id")
    best = keep(best.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k).select("item", "score", "class_id"), "best")

    hashed = F.xxhash64("m", "terms", "tfs")
    wanted = keep(classes.join(small_or_shuffled(best.select("class_id").distinct()), "class_id").select("class_id", "m", "terms", "tfs", hashed.alias("h")), "wanted")
    members = bag.withColumn("h", hashed).join(small_or_shuffled(wanted.select("h").distinct()), "h", "left_semi")
    in_class = Window.partitionBy("h", "m", "terms", "tfs").orderBy(F.col("doc_id").asc_nulls_last())
    members = members.withColumn("place", F.row_number().over(in_class)).where(F.col("place") <= k)
    members = members.join(wanted, ["h", "m", "terms", "tfs"]).select("class_id", "doc_id")
    names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(ids.dictionary))), "item_id": ids.dictionary}))
    in_item = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    found = best.join(members, "class_id").withColumn("rank", F.row_number().over(in_item)).where(F.col("rank") <= k)
    return found.join(names, "item").select(F.col("item_id").cast(kind), "rank", "doc_id", "score")
