"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Documents become token ids and an end id; only those longer than a sequence are cut. Pieces as long as a sequence are
sequences of their own. The others are dealt by a hash into groups of about GROUP pieces, so that no group depends on a
source or on equal lengths; a task packs its group best-fit decreasing, then moves documents, exchanges one for one and
two for one between underfull bins wherever this adds to the squared fill, until bins empty. Bins that stay less full
than CLOSED are opened again and packed together with those of other groups, in fewer groups each round.

Cases: null and empty text have the end id alone. Repeated rows are documents of their own. A null doc_id is kept.
A very long text is tokenised by itself and cut into pieces. Pieces of equal length are told apart by an own id, so ties
don't change the number of sequences. Other columns are kept, but for those named sequence_id and offset, which are
replaced. An empty table gives no rows.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.shared import give_back, keep

SIZE, END, GROUP, CLOSED = 2048, 0, 40_000, 0.98
#: Documents for which a group tries to find a better place. This bounds the time of the search alone: every piece is packed, better or worse.
MOVES = 20_000
#: Words whose ids a worker remembers.
WORDS = 300_000

#: Bytes of text that are tokenised at a time, of which a worker holds some dozen times as much in words and ids; one longer text is a part of its own.
PART = 1 << 20
#: Characters that, after a plain letter or digit, begin a token and end it with the word; texts whose words a tokenizer must not join.
TAIL, PROBES = "#$%&*+,-./:;=?@^_~!", ("a b", "a  b\n", "\t. 1\x0bx ", " and the")
_KNOWN: dict[str, dict[str, bytes]] = {}


def _tokenizer(path: str):
    """The tokenizer, if it encodes every word by itself; others would get other ids here than from whole texts."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    if any(ids(p) != [i for w in p.split() for i in ids(w)] for p in PROBES):
        raise ValueError(f"tokens of {path} hold white space; such a tokenizer can't be used word by word")
    return tokenizer


def _bare(path: str):
    """A tokenizer for printable ASCII words in lower case: without the normalizer, if all its steps leave such words as they are."""
    from tokenizers import Tokenizer, normalizers

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        own = json.load(f)["normalizer"] or {"type": "Sequence", "normalizers": []}
    steps = own["normalizers"] if own["type"] == "Sequence" else [own]
    if all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} for s in steps):
        tokenizer.normalizer = normalizers.Sequence([])
    return tokenizer


def _flat(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids one after the other, where those of each value begin, and how many they are."""
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    return np.frombuffer(b"".join(values), np.uint32), np.cumsum(sizes) - sizes, sizes


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The values numbered by order, one after the other."""
    n = sizes[order]
    return flat[np.repeat(starts[order] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def word_ids(path: str):
    """A function from texts (no nulls) to all their ids and how many each has, for tokenizers in which no token crosses white space.

    Distinct words of the texts are encoded once, without what punctuation ends them; a worker remembers WORDS of them.
    """
    tokenizer, bare, known = _tokenizer(path), _bare(path), _KNOWN.setdefault(path, {"": b""})

    def of_words(words: pa.Array) -> list[bytes]:
        words = words.to_pylist()
        new = [w for w in words if w not in known]
        own = {}
        plain = [w.isascii() and w.isprintable() and "<" not in w for w in new]
        for encoder, some in ((bare, [w for w, ok in zip(new, plain) if ok]), (tokenizer, [w for w, ok in zip(new, plain) if not ok])):
            if some:  # words given as already split are each a sequence of their own, as in a call for each, but come back as one
                got = encoder.encode(some, is_pretokenized=True, add_special_tokens=False)
                ids = array("I", got.ids).tobytes()
                ends = np.cumsum(np.bincount(np.array(got.word_ids, np.int64), minlength=len(some)) * 4).tolist()
                own.update(zip(some, map(ids.__getitem__, map(slice, [0, *ends], ends))))
        if len(known) < WORDS:
            known.update(own)
            own = known
        return [own[w] if w in own else known[w] for w in words] if own is not known else list(map(known.__getitem__, words))

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        words = split.flatten().dictionary_encode()
        ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        unique = words.dictionary
        plain = pc.invert(pc.match_substring(unique, "<"))  # control strings of the tokenizer begin so and keep their case
        lower = pc.if_else(plain, pc.ascii_lower(unique), unique)
        core = pc.ascii_rtrim(lower, characters=TAIL)
        core = pc.if_else(pc.match_substring_regex(core, "[0-9a-zÀ-ÖØ-öø-ÿ]$"), core, lower)
        cut = pc.not_equal(core, lower)
        ended = pc.indices_nonzero(cut).to_numpy()
        tails = [w[len(c) :] for w, c in zip(lower.filter(cut).to_pylist(), core.filter(cut).to_pylist())]
        parts = pa.concat_arrays([core, pa.array(["", *tails], pa.large_string())]).dictionary_encode()
        flat, starts, sizes = _flat(of_words(parts.dictionary))
        own = parts.indices.to_numpy()
        both = np.stack([own[: len(unique)], np.full(len(unique), own[len(unique)])], 1)
        both[ended, 1] = own[len(unique) + 1 :]
        order = both[words.indices.to_numpy()].ravel()
        total = np.append(0, np.cumsum(sizes[order]))
        return _gathered(flat, starts, sizes, order), np.diff(total[2 * ends])

    return encode


def tokenized(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, piece, start, length, ids (little-endian unsigned 32-bit)."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = word_ids(tokenizer)
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            weight, lo = np.cumsum(pc.binary_length(text).to_numpy()), 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(weight, (weight[lo - 1] if lo else 0) + PART, "right")))
                ids, counts = encode(text.slice(lo, hi - lo))
                ids = np.insert(ids, np.cumsum(counts), end).astype("<u4") if len(ids) else np.full(hi - lo, end, "<u4")
                counts = counts + 1
                pieces = -(-counts // size)
                doc = np.repeat(np.arange(hi - lo), pieces)
                piece = np.arange(len(doc)) - (np.cumsum(pieces) - pieces)[doc]
                length = np.minimum(counts[doc] - piece * size, size)
                cuts = np.append(0, np.cumsum(length))
                for a in range(0, len(doc), 4096):
                    b = min(a + 4096, len(doc))
                    data = pa.py_buffer(ids[cuts[a] : cuts[b]].tobytes())
                    offsets = pa.py_buffer((4 * (cuts[a : b + 1] - cuts[a])).astype(np.int32).tobytes())
                    binary = pa.Array.from_buffers(pa.binary(), b - a, [None, offsets, data])
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).take(pa.array(doc[a:b])), pa.array(piece[a:b].astype(np.int32)), pa.array(piece[a:b].astype(np.int64) * size), pa.array(length[a:b].astype(np.int64)), binary], ["doc_id", "piece", "start", "length", "ids"])
                lo = hi
            give_back()
        _KNOWN.pop(tokenizer, None)  # the worker lives on, idle, beside those of later stages
        give_back()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, size: int = SIZE) -> list[list[int]]:
    """Bins of places in lengths: each, from the longest on, goes where it leaves the least room."""
    bins, room, open_, mask = [], [], [[] for _ in range(size + 1)], 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = open_[left].pop()
            if not open_[left]:
                mask &= ~(1 << left)
        else:
            left, b = size, len(bins)
            bins.append([])
            room.append(size)
        bins[b].append(i)
        room[b] = left = left - n
        if left:
            open_[left].append(b)
            mask |= 1 << left
    return bins


def _two_for_one(n: int, docs: np.ndarray, lengths: np.ndarray) -> tuple[int, int, list[int]] | None:
    """Of all pairs of documents of one bin, in docs (document, bin, room; a bin's rows together), that which n replaces with the most gain."""
    found = None
    for apart in range(1, len(docs)):
        same = np.flatnonzero(docs[apart:, 1] == docs[:-apart, 1])
        if not len(same):
            break
        gain = n - lengths[docs[same, 0]] - lengths[docs[same + apart, 0]]
        gain[gain > docs[same, 2]] = 0
        best = int(np.argmax(gain))
        if gain[best] > 0 and (not found or gain[best] > found[0]):
            found = int(gain[best]), int(docs[same[best], 1]), [int(docs[same[best], 0]), int(docs[same[best] + apart, 0])]
    return found


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int = SIZE, moves: int = MOVES) -> list[list[int]]:
    """Fewer or fuller bins, by moves and exchanges that add to the squared fill; bins that empty are left out."""
    fill = np.array([int(lengths[b].sum()) for b in bins], np.int64)
    under = [k for k in range(len(bins)) if fill[k] < size]
    left = moves
    for target in sorted(under, key=lambda k: fill[k]):
        better = True
        while better and bins[target] and left > 0:
            better = False
            others = [k for k in under if k != target and bins[k] and fill[k] >= fill[target] and fill[k] < size]
            if not others:
                break
            room = size - fill[others]
            docs = np.array([(i, k, r) for k, r in zip(others, room.tolist()) for i in bins[k]], np.int64)
            for x in sorted(bins[target], key=lambda i: -lengths[i]):
                left -= 1
                n = int(lengths[x])
                fits = np.flatnonzero(room >= n)
                if len(fits):
                    to, back = others[fits[np.argmin(room[fits])]], []
                else:
                    gain = n - lengths[docs[:, 0]]
                    ok = np.flatnonzero((gain > 0) & (gain <= docs[:, 2]))
                    if len(ok):
                        best = ok[np.argmax(gain[ok])]
                        to, back = int(docs[best, 1]), [int(docs[best, 0])]
                    else:
                        found = _two_for_one(n, docs, lengths)
                        if not found:
                            continue
                        _, to, back = found
                bins[target] = [i for i in bins[target] if i != x] + back
                bins[to] = [i for i in bins[to] if i not in back] + [x]
                change = n - int(lengths[back].sum()) if back else n
                fill[target] -= change
                fill[to] += change
                better = True
                break
    return [b for b in bins if b]


def packed(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces (with length, and any columns) and two more: sequence_id and offset, in place of columns that had these names."""
    pieces = keep(pieces.drop("sequence_id", "offset").withColumn("_own_id", F.monotonically_increasing_id()), "pieces")
    whole = pieces.where(F.col("length") >= size)
    done = [whole.withColumn("sequence_id", F.col("_own_id")).withColumn("offset", F.lit(0).cast("long"))]
    rest, groups, turn, final = pieces.where(F.col("length") < size), None, 0, False
    schema = pieces.schema.simpleString()[7:-1].replace(":", " ") + ", sequence_id bigint, offset bigint, _again boolean"
    while not final and (count := rest.count()):
        before, groups, turn = groups, -(-count // GROUP), turn + 1
        final = groups == 1 or before is not None and groups >= before
        dealt = rest.withColumn("_deal", F.pmod(F.xxhash64("_own_id", F.lit(turn)), F.lit(groups)))
        got = keep(dealt.groupBy("_deal").applyInArrow(_packer(size, -(turn << 56), final), schema), "packed")
        done.append(got.where("NOT _again").drop("_again"))
        rest = got.where("_again").drop("_again", "sequence_id", "offset")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("_own_id")


def _packer(size: int, head: int, final: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.drop_columns(["_deal"]).sort_by("_own_id")  # the same bins in whatever order the shuffle brings the rows
        lengths, own = table.column("length").to_numpy(), table.column("_own_id").to_numpy()
        sequence, offset, again = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), np.zeros(len(own), bool)
        for b in local_search(best_fit(lengths, size), lengths, size):
            ends = np.cumsum(lengths[b])
            sequence[b] = head - own[min(b)] - 1
            offset[b] = ends - lengths[b]
            again[b] = not final and ends[-1] < CLOSED * size
        for name, values in (("sequence_id", sequence), ("offset", offset), ("_again", again)):
            table = table.append_column(name, pa.array(values))
        return table

    return run
