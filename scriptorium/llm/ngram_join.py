"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Method, after the size-aware heavy-light overlap join:

1. Texts with equal sets are one class (told apart by 64 bits), so copies are never paired.
2. Sets are ordered: shingles that recur in many classes come last, in levels, the others by hash. Anchors, the minima
   of every SPAN shingles of a text, are counted over all texts, and then all shingles beside frequent anchors; the
   levels are bit tables of bounded size. Any order is exact, a good one is short of chance meetings. Similar sets of n shingles share a shingle among their first p = n - ceil(0.8 n) + 1, and two among
   their first p + 1. A light (small) set enumerates all two-element subsets of its first p + 1; a heavy (large) one is
   put on the inverted lists of its first p. The boundary is the size up to which a set's subsets cost no more than its
   inverted lists; sets that may pair with both kinds are put on both.
3. Keys are counted alone; only those that occur twice are looked at together with their classes.
4. If the first shingle that two sets share is a frequent one, they share no rare one: all rare ones of both are then
   differences. So on lists of frequent shingles only classes meet that have few rare ones between them.
5. Lists of up to SHORT classes give all their pairs. On a longer one, each class is paired with a few leaders only; if
   the list then falls into one component, no pair of it can change the result. Other lists give their pairs across
   components; the longest of them only after a further round, in which the order is by their classes' own exact counts,
   so that these meet on rarer shingles, and under other leaders.
6. Parity sketches, a fraction of a set's size, differ in no more bits than the sets in shingles; pairs that differ in
   more than similar sets may are no links. The others are verified on whole sets.

No cap drops a pair: the leaders and the order decide only how pairs are found.

Cases: null text, empty text and text without words give an empty set, which links with nothing. Fewer than five words
make one shingle. Null doc_id: the row gets the component of the documents with the same set, or null. Repeated rows:
each is returned, with the same component; rows of one doc_id with different texts are classes of their own, and each
row gets its class's component. Very long texts are taken whole, one at a time. Ties in the order fall to the hash.
Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import words as W
from scriptorium.llm.shared import bit_table, components, give_back, has_bit, keep, small_or_shuffled

K, PERCENT = 5, 80
SHORT = 8
#: Length of lists up to which those that leaders leave apart give their pairs across components without another round.
MEDIUM = 512
LEADERS = 16
ROUNDS = 2
#: Counts above which shingles come later in the order.
LEVELS = (SHORT, 8 * SHORT, 128 * SHORT)
#: Shingles of which one is an anchor, and how far from a frequent one others are counted.
SPAN, BESIDE = 32, 24
#: Shingles that a task counts at a time.
WINDOW = 1 << 21
#: Bits of a sketch, at least.
SKETCH = 1024
#: Sizes on which the cost of inverted lists is measured, and up to which the boundary may lie.
MOST_LIGHT = 64


def prefix_length(n: int) -> int:
    return n - (-(-PERCENT * n // 100)) + 1


def _sets(batch: pa.RecordBatch, name: str):
    """Sorted distinct shingle hashes, as int64, of every row."""
    for _, flat, counts in W.shingled(batch.column(name), K):
        ends = np.append(0, np.cumsum(counts))
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            yield np.unique(flat[a:b].view(np.int64))


def _class(s: np.ndarray) -> int:
    """64 bits that stand for a set."""
    u = s.view(np.uint64)
    with np.errstate(over="ignore"):
        both = np.sum(u, dtype=np.uint64) ^ W.mix(np.sum(W.mix(u ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64))
    return int(both.view(np.int64))


def _lists(items: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, items)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(items) if items else np.zeros(0, np.int64), pa.int64()))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))


def _anchors(flat: np.ndarray) -> np.ndarray:
    """The minima of every SPAN values in a row, or the least of fewer."""
    m, width = flat, 1
    while width < SPAN and len(m) > width:  # SPAN is a power of two
        m, width = np.minimum(m[:-width], m[width:]), 2 * width
    return np.unique(m if width == SPAN else m.min(keepdims=True))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n (set size), cid (class), head (of small sets, the first shingles by hash); and rows with n null, whose head and times are counts of anchors."""
    schema = "doc_id long, text_key long, n long, cid long, head array<long>, times array<long>"

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        tok, times = np.unique(np.concatenate(held), return_counts=True)
        cuts = range(0, len(tok), 1 << 16)
        none = pa.nulls(len(cuts), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, _lists([tok.view(np.int64)[c : c + (1 << 16)] for c in cuts]), _lists([times[c : c + (1 << 16)] for c in cuts])], ["doc_id", "text_key", "n", "cid", "head", "times"])

    def run(batches):
        held, size, seen = [], 0, set()
        for batch in batches:
            n, cid, head = [], [], []
            for _, flat, counts in W.shingled(batch.column("text"), K):
                ends = np.append(0, np.cumsum(counts))
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    s = np.unique(flat[a:b].view(np.int64))
                    n.append(len(s))
                    cid.append(_class(s))
                    head.append(s[: prefix_length(len(s))] if 1 < len(s) <= MOST_LIGHT else s[:0])
                    if len(s) > 1 and cid[-1] not in seen:
                        seen.add(cid[-1])
                        own = flat[a:b]
                        held.append(_anchors(own))
                        size += len(held[-1])
            if size > WINDOW:
                yield counted(held)
                held, size, seen = [], 0, set()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), _lists(head), pa.nulls(len(n), pa.list_(pa.int64()))], ["doc_id", "text_key", "n", "cid", "head", "times"])
        if held:
            yield counted(held)

    return _plain(docs).mapInArrow(run, schema)


def _places(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places in flat of the anchors of the texts that stand there one after the other, counts[i] shingles each; windows over two texts add some."""
    bits = np.uint64(len(flat).bit_length())
    m, width = flat >> bits << bits | np.arange(len(flat), dtype=np.uint64), 1
    least = np.minimum.reduceat(m, (np.cumsum(counts) - counts)[counts > 0]) if len(m) else m
    while width < SPAN and len(m) > width:
        m, width = np.minimum(m[:-width], m[width:]), 2 * width
    m = np.append(m[np.append(True, m[1:] != m[:-1])], least) if len(m) else m
    return (np.unique(m) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _beside(docs: DataFrame, frequent) -> DataFrame:
    """tok, times of all shingles beside anchors in the bit table frequent.

    Only anchors are looked up: a bit table is wrong for some of all values, and each of these would count all that stand beside it.
    """

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        tok, times = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(tok.view(np.int64)), pa.array(times.astype(np.int64))], ["tok", "times"])

    def run(batches):
        table, held, size = frequent.value, [], 0
        for batch in batches:
            for _, flat, counts in W.shingled(batch.column("text"), K):
                hit = _places(flat, counts)
                hit = hit[has_bit(table, flat[hit].view(np.int64))]
                edge = np.zeros(len(flat) + 1, np.int32)
                np.add.at(edge, np.maximum(hit - BESIDE, 0), 1)
                np.add.at(edge, np.minimum(hit + BESIDE + 1, len(flat)), -1)
                held.append(flat[np.cumsum(edge[:-1]) > 0])  # the texts beside add a few of their own, which are rare
                size += len(held[-1])
                if size > WINDOW:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return docs.select("text").mapInArrow(run, "tok long, times long").groupBy("tok").agg(F.sum("times").alias("times"))


def _ordered(s: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """A set in the order, as far as its first p + 1, and how many of all its shingles are in no level."""
    level = np.zeros(len(s), np.int8)
    for bits in levels:
        level += has_bit(bits, s)
    n = prefix_length(len(s)) + 1
    rare = int(np.count_nonzero(level == 0))
    if rare == len(s):
        return s[:n], rare
    return s[np.argsort(level, kind="stable")[:n]], rare


def _heads(docs: DataFrame, levels) -> DataFrame:
    """cid, n, rare (how many shingles are in no level), head of the classes of docs; classes that a task has just seen are left out."""

    def run(batches):
        tables, seen = levels.value, set()
        for batch in batches:
            rows = [[], [], [], []]
            for s in _sets(batch, "text"):
                if len(s) < 2 or (cid := _class(s)) in seen:
                    continue
                seen.add(cid)
                head, rare = _ordered(s, tables)
                for column, value in zip(rows, (cid, len(s), rare, head)):
                    column.append(value)
            if len(seen) > 1 << 18:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), _lists(rows[3])], ["cid", "n", "rare", "head"])

    return docs.select("text").mapInArrow(run, "cid long, n int, rare int, head array<long>")


def _keys(heads: DataFrame, light: int, repeated=None) -> DataFrame:
    """key (a shingle, or two as one hash), cid, n, rare (-1 where a rare shingle is in the key); only keys in the bit table repeated, if given."""

    def run(batches):
        wanted = repeated.value if repeated else None
        for batch in batches:
            flat, ends = batch.column("head").flatten().to_numpy(), batch.column("head").offsets.to_numpy()
            ends = (ends - ends[0]).tolist()
            keys, meta, sizes = [], [], []
            for cid, n, rare, a, b in zip(batch.column("cid").to_pylist(), batch.column("n").to_pylist(), batch.column("rare").to_pylist(), ends[:-1], ends[1:]):
                head, own = flat[a:b], []
                if n <= light:
                    i, j = np.triu_indices(len(head), 1)
                    u = head.view(np.uint64)
                    low, high = np.minimum(u[i], u[j]), np.maximum(u[i], u[j])
                    own.append((W.mix(low * np.uint64(0xA0761D6478BD642F) ^ high).view(np.int64), i >= rare))
                if 100 * n >= PERCENT * (light + 1):  # may pair with a heavy one, or is one
                    p = prefix_length(n)
                    own.append((head[:p], np.arange(p) >= rare))
                for key, common in own:
                    if 4 * rare > n:  # too many rare ones to be similar without sharing any
                        key, common = key[~common], common[~common]
                    keys.append(key)
                    meta.append(np.where(common, rare, -1))
                    sizes.append((cid, n, len(key)))
            if keys:
                cid, n, times = np.array(sizes, np.int64).T
                columns = [np.concatenate(keys), np.repeat(cid, times), np.repeat(n, times).astype(np.int32), np.concatenate(meta).astype(np.int32)]
                if wanted is not None:
                    on = has_bit(wanted, columns[0])
                    columns = [c[on] for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "cid", "n", "rare"])

    return heads.mapInArrow(run, "key long, cid long, n int, rare int")


def _of_classes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text, cid of the first documents of the wanted classes (cid, first); of a repeated doc_id, all its texts."""
    wanted = small_or_shuffled(wanted.select("cid", F.col("first").alias("doc_id")))
    return _plain(docs).join(wanted, "doc_id")


def _sets_of(docs: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """cid, s (all shingles) of the wanted classes (cid, first), read from the text of a class's first document.

    Only where a doc_id is repeated may a class come twice; only then the sets are shuffled to keep one.
    """

    def run(batches):
        for cids, sets in _wanted_sets(batches):
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), _lists(sets)], ["cid", "s"])

    sets = _of_classes(docs, wanted).select("cid", "text").mapInArrow(run, "cid long, s array<long>")
    return sets.dropDuplicates(["cid"]) if repeated else sets


def _wanted_sets(batches):
    """From batches of cid and text, 256 classes and their sets at a time; texts of other classes are left out."""
    for batch in batches:
        cids, sets = [], []
        for cid, s in zip(batch.column("cid").to_pylist(), _sets(batch, "text")):
            if _class(s) == cid:
                cids.append(cid)
                sets.append(s)
            if len(sets) == 256:
                yield cids, sets
                cids, sets = [], []
        if sets:
            yield cids, sets
        give_back()


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, repeated: bool) -> DataFrame:
    """Of candidate pairs (a, b: cid), similar ones that join the same classes as all similar ones do.

    Sketches, which are small, rule out most others. Of the rest each class is compared with its smallest partner; pairs
    of classes that are similar to the same one by then are joined already, and all other pairs are compared too.
    """

    def compared(near):
        near = keep(near, "compared")
        sets = keep(_sets_of(docs, _ends(near, classes), repeated), "sets")
        both = small_or_shuffled(near).join(sets.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a")
        both = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("common"))
        return keep(both.where(f"100 * common >= {PERCENT} * (total - common)").select("a", "b"), "links")

    pairs = keep(pairs.distinct(), "pairs")
    near = keep(_near(pairs, keep(_sketches(docs, _ends(pairs, classes), repeated), "sketches")), "near")
    first = compared(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    named = lambda x: first.select(F.col("b").alias(x), F.col("a").alias(f"of_{x}"))
    rest = near.join(named("a"), "a", "left").join(named("b"), "b", "left").where("coalesce(of_a, a) <> coalesce(of_b, b)")
    return first.unionByName(compared(rest.select("a", "b")))


def _near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose sketches differ in no more bits than similar sets may in shingles; the larger one is folded first."""

    def run(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            most = (100 - PERCENT) * (batch.column("na").to_numpy() + batch.column("nb").to_numpy())
            for i, (x, y) in enumerate(zip(batch.column("ka"), batch.column("kb"))):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                while len(x) != len(y):
                    x, y = (x, y) if len(x) > len(y) else (y, x)
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                ok[i] = (100 + PERCENT) * int(np.bitwise_count(x ^ y).sum()) <= most[i]
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    sketches = sketches.drop("folded")
    marked = pairs.join(sketches.withColumnsRenamed({"cid": "a", "n": "na", "k": "ka"}), "a").join(sketches.withColumnsRenamed({"cid": "b", "n": "nb", "k": "kb"}), "b")
    return marked.where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)").mapInArrow(run, "a long, b long")


def _ends(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes (cid, first) in pairs."""
    ids = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    return keep(classes.join(ids, "cid").select("cid", "first"), "ends")


def _sketches(docs: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """cid, n, k, folded of the sets of the wanted classes: k has a bit for the parity of the shingles that fall on it, two or more bits a shingle; folded is k in SKETCH bits.

    A set becomes its sketch in the task that reads its text; a second function after that of _sets_of() would be a second worker beside each first one.
    """

    def run(batches):
        for cids, sets in _wanted_sets(batches):
            n, k, folded = [], [], []
            for s in sets:
                bits = max(SKETCH, 1 << int(2 * len(s) - 1).bit_length())
                n.append(len(s))
                k.append(np.packbits(np.bincount(s & (bits - 1), minlength=bits).astype(np.uint8) & 1))
                folded.append(np.bitwise_xor.reduce(k[-1].reshape(-1, SKETCH // 8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in k], pa.binary()), _lists(folded)], ["cid", "n", "k", "folded"])

    sketches = _of_classes(docs, wanted).select("cid", "text").mapInArrow(run, "cid long, n long, k binary, folded array<long>")
    return sketches.dropDuplicates(["cid"]) if repeated else sketches


def _light(small: DataFrame) -> int:
    """The boundary: the largest size whose subsets are no more rows than its inverted lists hold entries to scan."""
    lists = small.select(F.explode("head").alias("tok")).groupBy("tok").count()
    got = lists.agg(F.sum(F.col("count") * F.col("count")).alias("scan"), F.sum("count").alias("rows")).first()
    partners = (got["scan"] / got["rows"]) if got["rows"] else 0
    return max([n for n in range(2, MOST_LIGHT + 1) if (prefix_length(n) + 1) / 2 <= 1 + partners], default=1)


def _levels(counts: DataFrame):
    """Bit tables of the shingles (tok, times) above each of LEVELS, broadcast."""
    counts = keep(counts.where(F.col("times") > LEVELS[0]), "often")
    return counts.sparkSession.sparkContext.broadcast([bit_table(counts.where(F.col("times") > level), "tok") for level in LEVELS])


#: Two folded sketches, too, differ in no more bits than the sets in shingles.
_FOLDED = f"{100 + PERCENT} * (" + " + ".join(f"bit_count(ka[{i}] ^ kb[{i}])" for i in range(SKETCH // 64)) + f") <= {100 - PERCENT} * (na + nb)"

#: Whether two classes on a list may be similar: by size, and on a list of frequent shingles by what is rare in them.
_MAY = f"a < b AND 100 * least(na, nb) >= {PERCENT} * greatest(na, nb) AND (ra < 0 OR {100 + PERCENT} * (ra + rb) <= {100 - PERCENT} * (na + nb))"


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text); and text_key (hash of the text), component_key (one for each component)."""
    rows = keep(signatures(docs), "signatures")
    spark = docs.sparkSession
    anchors = rows.where("n IS NULL").select(F.explode(F.arrays_zip("head", "times")).alias("x")).groupBy("x.head").agg(F.sum("x.times").alias("times")).withColumnRenamed("head", "tok")
    rows = rows.where("n IS NOT NULL")
    repeated = not rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    classes = keep(rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("first")).where("first IS NOT NULL"), "classes")
    light = _light(rows.where(f"n BETWEEN 2 AND {MOST_LIGHT}"))
    read, links = _plain(docs).where("doc_id IS NOT NULL"), None
    anchors = keep(anchors.where(F.col("times") > LEVELS[0]).select("tok"), "anchors")
    levels = _levels(_beside(read, spark.sparkContext.broadcast(bit_table(anchors, "tok"))))
    for turn in range(ROUNDS):
        heads = keep(_heads(read, levels), "heads")
        twice = keep(_keys(heads, light).groupBy("key").count().where("count > 1").select("key"), "twice")
        members = keep(_keys(heads, light, spark.sparkContext.broadcast(bit_table(twice, "key"))), "members")
        lists = members.groupBy("key").agg(F.count("*").alias("rows"), F.min("cid").alias("least"), F.max("cid").alias("most")).where("least < most")
        lists = keep(lists.select("key", "rows"), "lists")
        members = members.join(small_or_shuffled(lists), "key")
        side = lambda x: F.struct(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("rare").alias(f"r{x}")).alias(x)
        flat = lambda df: df.select("key", "x.*", "y.*").where(_MAY).select("a", "b").distinct()
        short, long = members.where(f"rows <= {SHORT}"), keep(members.where(f"rows > {SHORT}"), "long")
        pairs = flat(short.select("key", side("a").alias("x")).join(short.select("key", side("b").alias("y")), "key"))
        draw = F.struct(F.xxhash64("cid", F.pmod("key", F.lit(LEADERS)), F.lit(turn)).alias("h"), F.col("cid").alias("leader"), F.col("n").alias("nl"), F.col("rare").alias("rl"))
        led = f"rare < 0 OR {100 + PERCENT} * rare <= {100 - PERCENT} * n"
        leaders = long.where(led).groupBy("key").agg(F.min(draw).alias("d")).select("key", "d.leader", "d.nl", "d.rl")
        stars = long.join(leaders, "key").where("cid <> leader").selectExpr("least(cid, leader) AS a", "greatest(cid, leader) AS b", "n AS na", "nl AS nb", "rare AS ra", "rl AS rb")
        new = _verified(docs, classes, pairs.union(stars.where(_MAY).select("a", "b")), repeated)
        links = new if links is None else links.unionByName(new)
        roots = keep(components(links), "roots")
        placed = long.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        apart = placed.join(leaders.select("key"), "key", "left_semi").groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
        apart = keep(placed.join(apart, "key"), "apart")
        if apart.isEmpty():
            break
        now = apart.where(F.col("rows") <= (MEDIUM if turn < ROUNDS - 1 else 1 << 62))
        marks = keep(_sketches(docs, keep(now.select("cid").distinct().join(classes, "cid"), "ends"), repeated), "sketches")
        marked = now.drop("n").join(marks, "cid")
        x, y = (marked.selectExpr("key", f"cid AS {s}", f"root AS root_{s}", f"n AS n{s}", f"rare AS r{s}", f"folded AS k{s}") for s in "ab")
        rest = x.join(y, "key").where(f"{_MAY} AND root_a <> root_b AND {_FOLDED}").select("a", "b")
        links = links.unionByName(_verified(docs, classes, rest, repeated))
        moved = keep(apart.where(f"rows > {MEDIUM}").select("cid").distinct().join(classes, "cid"), "moved")
        if turn == ROUNDS - 1 or moved.isEmpty():
            roots = keep(components(links), "roots")
            break
        levels = _levels(_sets_of(docs, moved, repeated).select(F.explode("s").alias("tok")).groupBy("tok").agg(F.count("*").alias("times")))
        read = _of_classes(docs, moved)
    grouped = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    known = keep(grouped.join(smallest, "root").select("cid", "root", "component_id"), "known")
    out = rows.select("doc_id", "text_key", "n", "cid").join(known, "cid", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "text_key", F.coalesce("root", "cid").alias("component_key"))
