"""Hidden Markov language model over words: Baum-Welch counts summed across partitions, exact scaled forward scores.

A text is its words (A-Z as a-z) and one end token. STATES latent states emit tokens; every token of the training texts
has an emission probability of its own in each state, kept as a table (token, n, one count a state) that grows with the
corpus. It is the base probability times the state's share of the token's counts over its share of all, the former
smoothed by SMOOTH uses in the mean shares, and divided by the sum over all trained tokens and one unseen.

1. Texts are cut into words once and kept in blocks of about BLOCK tokens: distinct tokens of the block (64-bit hashes),
   how often each stands in its training texts, and every text as places in that list.
2. Counts of all tokens are a sum over the blocks' lists.
3. Baum-Welch, TIED rounds: tokens share symbols, the HEAD most frequent have their own, all others fall by hash on as
   many again. The model has a bounded size and is broadcast; only its start, moves and soft classes matter later.
4. Baum-Welch, the last round: expected counts of every token by state, summed over all blocks, are the emissions.
5. Blocks are joined with the emissions of their own tokens, and scores are exact: the logarithms of the scales of a
   forward pass over each whole text.

Cases: null and empty texts are the end token alone. Null doc_id: scored, not learned from. Repeated rows are all
learned from and returned. A very long text is a block of its own, with one step for each token. Ties among counts only
move tokens between symbols. Other columns are ignored. With no training text, every token is unknown: N = V = 0. An
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import words as W
from scriptorium.llm.shared import keep

STATES, HEAD, TIED, SMOOTH, STAY, ADD = 6, 16_384, 2, 2.0, 0.9, 0.1
#: Tokens of a block, and cells (steps times texts) that are computed together; a longer text is on its own.
BLOCK, GROUP = 1 << 22, 1 << 20
#: Stands for the end token; no word has its hash but by chance.
END = np.int64(0x5DEECE66D1CE4E5B)
#: Expected counts are summed in these parts of one, which makes sums exact whatever their order; that of the last state is what is left of the token's count.
FINE = 1 << 10
COLUMNS = [f"c{k}" for k in range(STATES - 1)]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: distinct tokens (hashes), each token's place among them, text after text, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    words = split.flatten().dictionary_encode()
    ends = split.offsets.to_numpy() - split.offsets[0].as_py()
    names, place = words.dictionary, words.indices.to_numpy().astype(np.int64)
    data, offsets = W.texts(names)
    full = np.flatnonzero(np.diff(offsets) > 0)
    hashes = np.full(len(names) + 1, END)
    hashes[full] = W.words(data, offsets)[2].view(np.int64)
    solid = np.diff(offsets)[place] > 0 if len(names) else np.zeros(0, bool)
    counts = np.diff(np.append(0, np.cumsum(solid))[ends])
    place = np.insert(place[solid], np.cumsum(counts), len(names))
    often = np.bincount(place, minlength=len(hashes))
    order = np.argsort(-often, kind="stable")[: np.count_nonzero(often)]  # frequent ones first, so that places are small
    rank = np.zeros(len(hashes), np.int64)
    rank[order] = np.arange(len(order))
    return hashes[order], rank[place].astype(np.int32), counts + 1


def _coded(ids: np.ndarray) -> bytes:
    """Numbers under 2^24, byte by byte, compressed."""
    return pa.compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes(), "zstd", asbytes=True)


def _decoded(data: pa.Buffer, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 3 * n, "zstd"), np.uint8).reshape(3, n)
    return planes[0].astype(np.int32) | planes[1].astype(np.int32) << 8 | planes[2].astype(np.int32) << 16


def blocks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, held_out, text) as rows of many texts: block, doc_ids, held, sizes, learned (weights 0 or 1), vocabulary, times, ids (text after text, coded)."""
    schema = "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, learned array<boolean>, vocabulary array<long>, times array<long>, ids binary"
    names = ["block", "doc_ids", "held", "sizes", "learned", "vocabulary", "times", "ids"]
    one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t))

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            weight, lo = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)) // 6, 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(weight, (weight[lo - 1] if lo else 0) + BLOCK, "right")))
                part = batch.slice(lo, hi - lo)
                vocabulary, place, sizes = tokens(part.column("text"))
                order = np.argsort(sizes, kind="stable")  # texts of like length stand together
                ends = np.append(0, np.cumsum(sizes))
                held, ids = part.column("held_out").take(pa.array(order)), part.column("doc_id").take(pa.array(order))
                learned = pc.and_(pc.invert(held), pc.is_valid(ids))
                place = place[np.repeat(ends[order] - (np.cumsum(sizes[order]) - sizes[order]), sizes[order]) + np.arange(len(place))]
                mask = np.repeat(learned.to_numpy(zero_copy_only=False), sizes[order])
                times = np.bincount(place[mask], minlength=len(vocabulary))
                values = [one(ids, pa.int64()), one(held, pa.bool_()), one(sizes[order], pa.int32()), one(learned, pa.bool_()), one(vocabulary, pa.int64()), one(times, pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *values, pa.array([_coded(place)], pa.binary())], names)
                number, lo = number + 1, hi

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def _groups(ids: np.ndarray, sizes: np.ndarray):
    """Ranges of texts of like lengths (sizes, rising) and their ids, a row for each step, -1 past the end; the longest text comes first."""
    ends, hi = np.append(0, np.cumsum(sizes)), len(sizes)
    while hi > 0:
        longest = int(sizes[hi - 1])
        lo = max(hi - max(1, GROUP // longest), int(np.searchsorted(sizes, longest / 1.3 - 16)))
        lo = min(lo, hi - 1)
        own = sizes[lo:hi][::-1]
        x = np.full((longest, hi - lo), -1, np.int32)
        for k, i in enumerate(range(hi - 1, lo - 1, -1)):
            x[: own[k], k] = ids[ends[i] : ends[i + 1]]
        yield np.arange(hi - 1, lo - 1, -1), x, own
        hi = lo


def forward(x: np.ndarray, sizes: np.ndarray, model: dict, all_messages: bool = False):
    """log10 probability of each column of x (sizes falling); if asked for, also all scaled messages (step, state, column) and scales."""
    start, move = model["start"].astype(np.float32), model["move"].T.astype(np.float32).copy()
    steps, n = x.shape
    active = np.searchsorted(-sizes, -np.arange(steps), "left")  # columns longer than the step
    states = len(start)
    total, a = np.zeros(n), np.tile(start[:, None], (1, n))
    messages = np.zeros((steps, states, n), np.float32) if all_messages else None
    scales = np.ones((steps, n), np.float32)
    emit = model["emit"].astype(np.float32, copy=False)[:, x]  # (state, step, column)
    for t in range(steps):
        m = active[t]
        a = move @ a[:, :m] if t else a[:, :m]
        a *= emit[:, t, :m]
        s = a.sum(0)
        a /= s
        scales[t, :m] = s
        if all_messages:
            messages[t, :, :m] = a
    for t in range(0, steps, 256):
        total += np.log10(scales[t : t + 256], dtype=np.float64).sum(0)
    return total, (active, messages, scales, emit)


def expected(x: np.ndarray, sizes: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of the columns of x: of emissions (state, symbol), of moves and of starts."""
    states, move = len(model["start"]), model["move"].astype(np.float32)
    _, (active, posts, scales, emit) = forward(x, sizes, model, True)
    moves = np.zeros((states, states))
    b = np.ones((states, x.shape[1]), np.float32)
    for t in range(len(x) - 1, -1, -1):
        m = active[t]
        if t:
            into = emit[:, t, :m] * b[:, :m]
            into /= scales[t, :m]
            moves += posts[t - 1, :, :m] @ into.T
        posts[t, :, :m] *= b[:, :m]  # messages become posteriors where both are known; they sum to 1 but for rounding
        if t:
            b[:, :m] = move @ into
    known = x >= 0
    ids = x[known]
    counts = np.stack([np.bincount(ids, posts[:, k][known], model["emit"].shape[1]) for k in range(states)])
    return counts, moves * model["move"], posts[0].sum(1, dtype=np.float64)


def _texts_of(row: dict, learned: bool):
    """ids and sizes of a block's texts, all or those learned from."""
    sizes = np.asarray(row["sizes"], np.int64)
    ids = _decoded(row["ids"], int(sizes.sum()))
    if learned:
        own = np.asarray(row["learned"], bool)
        ids, sizes = ids[np.repeat(own, sizes)], sizes[own]
    return ids, sizes


def _rows(batches):
    """Blocks one by one."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i] for n in batch.schema.names}
            row |= {n: v.as_buffer() for n, v in row.items() if isinstance(v, pa.BinaryScalar)}
            row |= {n: row[n].values for n in ("doc_ids", "held") if n in row}
            yield row | {n: row[n].values.to_numpy(zero_copy_only=False) for n in ("sizes", "learned", "vocabulary", "times") if n in row}


def _symbols(vocabulary: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Place of each token in the sorted head, or a place after it by hash."""
    at = np.minimum(np.searchsorted(head, vocabulary), max(len(head) - 1, 0))
    own = head[at] == vocabulary if len(head) else np.zeros(len(vocabulary), bool)
    return np.where(own, at, len(head) + (vocabulary.view(np.uint64) % np.uint64(HEAD)).astype(np.int64))


def _e_step(kept: DataFrame, model: dict, head: np.ndarray, by_token: bool) -> DataFrame:
    """Expected counts of all blocks, in FINE parts, as rows key, times, c0..: by token; or by symbol, with keys under 0 for moves (-1 - from) and starts (-1 - STATES)."""
    shared = kept.sparkSession.sparkContext.broadcast((model, head))

    def out(keys, times, total):
        rows = np.flatnonzero(times > 0)
        return pa.RecordBatch.from_arrays([pa.array(keys[rows]), pa.array(times[rows].astype(np.int64)), *(pa.array(np.rint(total[k, rows] * FINE).astype(np.int64)) for k in range(STATES - 1))], ["key", "times", *COLUMNS])

    def run(batches):
        m, names = shared.value
        size, few = m["emit"].shape[1], np.zeros((STATES + 1, STATES))
        total, times = np.zeros((STATES, size)), np.zeros(size)
        for row in _rows(batches):
            ids, sizes = _texts_of(row, True)
            vocabulary = row["vocabulary"]
            symbols = _symbols(vocabulary, names)
            emit = m["emit"][:, symbols].astype(np.float32)
            counts = np.zeros((STATES, len(vocabulary)))
            for _, x, own in _groups(ids, sizes):
                c, v, s = expected(x, own, m | {"emit": emit})
                counts += c
                few += np.concatenate([v, s[None]])
            if by_token:
                yield out(vocabulary, row["times"], counts)
            else:
                times += np.bincount(symbols, row["times"], size)
                for k in range(STATES):
                    total[k] += np.bincount(symbols, counts[k], size)
        if not by_token:
            yield out(np.arange(size), times, total)
            yield out(-1 - np.arange(STATES + 1), few.sum(1), few.T)

    columns = [F.sum(c).alias(c) for c in ("times", *COLUMNS)]
    kept = kept.select("ids", "sizes", "learned", "vocabulary", "times")
    return kept.mapInArrow(run, "key long, times long, " + ", ".join(f"{c} long" for c in COLUMNS)).groupBy("key").agg(*columns)


def _all_states(times: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """Expected counts by state, of counts in FINE parts of all states but the last."""
    c = np.stack([p / FINE for p in parts]) if parts else np.zeros((0, len(times)))
    return np.maximum(np.concatenate([c, (times - c.sum(0))[None]]), 0)


def tilts(counts: np.ndarray, times: np.ndarray, share: np.ndarray) -> np.ndarray:
    """How much likelier a token is in a state (rows) than by the base: its share of the token's counts over the state's of all, with SMOOTH uses more by these."""
    return (counts + SMOOTH * share[:, None]) / ((times + SMOOTH) * share[:, None])


def m_step(counts: np.ndarray, moves: np.ndarray, starts: np.ndarray, base: np.ndarray) -> dict:
    share = (counts.sum(1) + 1) / (counts.sum() + len(counts))
    emit = base * tilts(counts, counts.sum(0), share)
    move = moves + 1 + 9 * np.eye(len(starts))
    return {"start": (starts + 1) / (starts.sum() + len(starts)), "move": move / move.sum(1, keepdims=True), "emit": emit / emit.sum(1, keepdims=True)}


def first_model(base: np.ndarray, states: int = STATES) -> dict:
    """Sticky states whose emissions are random tilts of the base distribution."""
    rng = np.random.default_rng(17)
    emit = base * np.exp(rng.normal(0, 0.6, (states, len(base))))
    move = np.full((states, states), (1 - STAY) / max(1, states - 1)) + np.eye(states) * (STAY - (1 - STAY) / max(1, states - 1))
    return {"start": np.full(states, 1 / states), "move": move, "emit": emit / emit.sum(1, keepdims=True)}


def _tied(kept: DataFrame, counts: DataFrame, base_of: float) -> tuple[dict, np.ndarray]:
    """The model over symbols after TIED rounds, and the sorted head."""
    top = counts.orderBy(F.desc("n"), "token").limit(HEAD).select("token").toArrow()  # a bounded list
    head = np.sort(top.column("token").to_numpy())
    spark = kept.sparkSession
    shared = spark.sparkContext.broadcast(head)

    def run(batches):
        total = np.zeros(len(shared.value) + HEAD)
        for b in batches:
            total += np.bincount(_symbols(b.column("token").to_numpy(), shared.value), b.column("n").to_numpy() + ADD, len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["symbol", "n"])

    sums = counts.select("token", "n").mapInArrow(run, "symbol long, n double").groupBy("symbol").agg(F.sum("n").alias("n")).toArrow()
    base = np.full(len(head) + HEAD, ADD / HEAD)
    base[sums.column("symbol").to_numpy()] += sums.column("n").to_numpy()
    base /= base.sum()
    model = first_model(base)
    for _ in range(TIED):
        got = _e_step(kept, model, head, False).toArrow()  # a row for each symbol
        key = got.column("key").to_numpy()
        values = _all_states(got.column("times").to_numpy(), [got.column(c).to_numpy() for c in COLUMNS])
        total, few = np.zeros((STATES, len(base))), np.zeros((STATES + 1, STATES))
        total[:, key[key >= 0]] = values[:, key >= 0]
        few[-1 - key[key < 0]] = values[:, key < 0].T
        model = m_step(total, few[:STATES], few[STATES], base)
    return model, head


def scores(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, held_out) as doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce("held_out", F.lit(False)).alias("held_out"))
    kept = keep(blocks(docs), "blocks")
    pairs = kept.select(F.explode(F.arrays_zip("vocabulary", "times")).alias("x")).select(F.col("x.vocabulary").alias("token"), F.col("x.times").alias("n"))
    counts = keep(pairs.where("n > 0").groupBy("token").agg(F.sum("n").alias("n")), "counts")
    got = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, base_of = got["n"], got["n"] + ADD * (got["v"] + 1)
    if total:
        model, head = _tied(kept, counts, base_of)
        table = keep(_e_step(kept, model, head, True).withColumnRenamed("key", "token").withColumnRenamed("times", "n"), "emissions")
        sums = table.agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in COLUMNS)).first()
        whole = _all_states(np.array([sums["n"]]), [np.array([float(sums[c])]) for c in COLUMNS])[:, 0]
        share = (whole + 1) / (whole.sum() + STATES)
    else:
        model, share = first_model(np.ones(1)), np.full(STATES, 1 / STATES)
        table = docs.sparkSession.createDataFrame([], "token long, n long, " + ", ".join(f"{c} long" for c in COLUMNS))
    parts = [F.col(c) / FINE for c in COLUMNS]
    parts.append(F.greatest(F.col("n") - sum(parts, F.lit(0.0)), F.lit(0.0)))
    weight = (F.col("n") + ADD) / base_of
    tilted = [F.sum(weight * (c + SMOOTH * float(p)) / ((F.col("n") + SMOOTH) * float(p))) for c, p in zip(parts, share)]
    got = table.agg(*(F.coalesce(t, F.lit(0.0)).alias(f"z{k}") for k, t in enumerate(tilted))).first()
    norm = np.array([got[f"z{k}"] for k in range(STATES)]) + ADD / base_of  # one unseen token more, as in the base
    return _scored(kept, table, model, share, norm, total, base_of)


def _scored(kept: DataFrame, table: DataFrame, model: dict, share: np.ndarray, norm: np.ndarray, total: int, base_of: float) -> DataFrame:
    """Scores of the texts of all blocks by start and moves of the model and the emissions in table (token, n, c0..)."""
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at, out = right.column("at").to_numpy(), []
        for row in _rows(left.to_batches()):
            size = len(row["vocabulary"])
            n, c = np.zeros(size), np.zeros((STATES, size))
            n[at] = right.column("n").to_numpy()
            c[:, at] = _all_states(n[at], [right.column(name).to_numpy() for name in COLUMNS])
            base = (n + ADD) / base_of
            emit = (base * tilts(c, n, share) / norm[:, None]).astype(np.float32)
            ids, sizes = _texts_of(row, False)
            ends = np.append(0, np.cumsum(sizes))
            sum_of = lambda v: np.diff(np.append(0, np.cumsum(v[ids]))[ends])  # noqa: E731, B023
            score = np.zeros(len(sizes))
            for place, x, own_sizes in _groups(ids, sizes):
                score[place] = forward(x, own_sizes, model | {"emit": emit})[0]
            exact = np.add.reduceat(np.log10(base)[ids], ends[:-1])
            columns = [row["doc_ids"], row["held"], sizes, sum_of((n > 0).astype(np.int64)), np.full(len(sizes), total), exact, score]
            out.append(pa.Table.from_arrays([pa.array(v, t) if isinstance(v, np.ndarray) else v for v, t in zip(columns, types)], names))
        return pa.concat_tables(out) if out else pa.schema(list(zip(names, types))).empty_table()

    wanted = kept.select(F.col("block").alias("of"), F.posexplode("vocabulary").alias("at", "token")).join(table, "token").drop("token")
    return kept.groupBy("block").cogroup(wanted.groupBy("of")).applyInArrow(run, schema)
