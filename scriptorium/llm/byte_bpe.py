"""Byte-level BPE with vectorised pre-tokenisation, and the way back.

Each code point gets a class from an array. A class stands for a transition function of an automaton with ten states,
and functions compose associatively: all products of the functions are numbered beforehand, so that composing two is one
look-up. The characters of many texts are laid out in columns; a first scan composes the functions of all columns side by
side, a second one, from the state in which each column begins, reads off the states. State and class say whether a piece
begins at a character or at the one before it. No regular expression reads a text.

Equal pieces are merged once: pieces are slices of the text's bytes, distinct ones are looked up in a cache or merged by
lowest rank, leftmost first; long ones with a heap. Ids are then gathered by numpy, with the byte at which each ends.

The classes of letters, numbers and white space are those of the library whose ranks are used, asked once a process.

Cases: a null or empty text has no token. Very long texts are taken whole, in a chunk of their own. Repeated rows and ids
stay rows of their own, a null doc_id too. An empty table gives no rows. Other columns are dropped.
"""

from __future__ import annotations

import base64
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.words import chunks, texts

#: The pattern that the automaton stands for, and the ends of words that it cuts off after an apostrophe.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SUFFIXES = ["s", "t", "re", "ve", "m", "ll", "d"]

#: Classes: the letters of SUFFIXES by themselves, one suffix alone being enough to end (ONE), other letters, numbers.
ONE, R, V, EL, E, LETTER, NUMBER, SPACE, WHITE, APOSTROPHE, OTHER = range(11)
CLASSES = 11
#: States: what the last character belongs to. QUOTE is an apostrophe at which a piece begins, QUOTE_R and so on an r after it, ENDED a whole suffix.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_WHITE, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, ENDED = range(10)
STATES = 10
#: A piece begins here, at the character before, or both.
HERE, BEFORE = 1, 2
#: Remembered pieces, and the longest of them in bytes; longer ones are merged anew.
CACHE, LONGEST = 1 << 19, 48
#: Bytes of text at a time.
CHUNK = 1 << 20


def _step(state: int, kind: int) -> tuple[int, int]:
    """The next state, and where pieces begin."""
    if kind in (SPACE, WHITE):
        into = AFTER_SPACE if kind == SPACE else AFTER_WHITE
        if state in (AFTER_SPACE, AFTER_WHITE):
            return into, 0
        return into, HERE | (BEFORE if state in (QUOTE_R, QUOTE_V, QUOTE_L) else 0)
    if kind <= LETTER:
        more = {(QUOTE, ONE): ENDED, (QUOTE, R): QUOTE_R, (QUOTE, V): QUOTE_V, (QUOTE, EL): QUOTE_L, (QUOTE_R, E): ENDED, (QUOTE_V, E): ENDED, (QUOTE_L, EL): ENDED}
        if (state, kind) in more:
            return more[state, kind], 0
        into, runs = IN_LETTERS, {IN_LETTERS}
        if state in (QUOTE_R, QUOTE_V, QUOTE_L):
            return into, BEFORE
    elif kind == NUMBER:
        into, runs = IN_NUMBERS, {IN_NUMBERS}
    else:
        into, runs = IN_OTHERS, {IN_OTHERS, QUOTE}
        if kind == APOSTROPHE and state not in (IN_OTHERS, QUOTE, AFTER_SPACE):
            into = QUOTE
    if state in runs:
        return into, 0
    if state == AFTER_SPACE:
        return into, BEFORE
    return into, HERE | (BEFORE if state in (AFTER_WHITE, QUOTE_R, QUOTE_V, QUOTE_L) else 0)


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Functions by number (from each state to the next), products (first, then second), and where pieces begin by state and class.

    Class c + CLASSES is class c as the first character of a text: its function forgets the state.
    """
    made, functions = {}, []
    for kind in range(2 * CLASSES):
        f = tuple(_step(AFTER_WHITE if kind >= CLASSES else s, kind % CLASSES)[0] for s in range(STATES))
        functions.append(f)
        made.setdefault(f, kind)
    for f in functions:  # grows while it is read
        for kind in range(2 * CLASSES):
            g = tuple(functions[kind][s] for s in f)
            if g not in made:
                made[g] = len(functions)
                functions.append(g)
    products = np.zeros((len(functions), 2 * CLASSES), np.int32)
    for i, f in enumerate(functions):
        for kind in range(2 * CLASSES):
            products[i, kind] = made[tuple(functions[kind][s] for s in f)]
    begins = np.zeros((STATES, 2 * CLASSES), np.uint8)
    for state in range(STATES):
        for kind in range(CLASSES):
            begins[state, kind] = _step(state, kind)[1]
            begins[state, kind + CLASSES] = HERE | (BEFORE if state in (QUOTE_R, QUOTE_V, QUOTE_L) else 0)
    return np.array(functions, np.uint8), products, begins


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    import tiktoken

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        asked = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = asked.decode_bytes(asked.encode_ordinary(every)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    for letters, kind in (("stmd", ONE), ("r", R), ("v", V), ("l", EL), ("e", E), (" ", SPACE), ("'", APOSTROPHE)):
        table[[ord(c) for c in letters]] = kind
    return table


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes at which pieces begin in texts laid end to end; offsets has the first byte of each text and the end."""
    if not len(data):
        return np.zeros(0, np.int64)
    functions, products, begins = automaton()
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    at = np.flatnonzero((data & 0xC0) != 0x80)
    kinds = classes()[points]
    kinds[np.searchsorted(at, offsets[:-1][offsets[:-1] < len(data)])] += CLASSES
    n = len(kinds)
    height = max(1, int(n**0.5) // 8)
    width = -(-n // height)
    grid = np.full(width * height, SPACE + CLASSES, np.uint8)  # what is left over counts as another text
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(width, height).T)
    done = grid[0].astype(np.int32)
    for row in grid[1:]:
        done = products[done, row]
    ends = functions[done]
    state = np.empty(width, np.uint8)
    now = AFTER_WHITE
    for i, f in enumerate(ends.tolist()):  # one look-up a column
        state[i] = now
        now = f[now]
    marks = np.empty_like(grid)
    first = functions[: 2 * CLASSES]
    for i, row in enumerate(grid):
        marks[i] = begins[state, row]
        state = first[row, state]
    marks = marks.T.reshape(-1)
    here = (marks[:n] & HERE).astype(bool)
    here[: n - 1] |= (marks[1:n] & BEFORE).astype(bool)
    if begins[now if n == width * height else 0, SPACE + CLASSES] & BEFORE or (n < width * height and marks[n] & BEFORE):
        here[n - 1] = True  # a piece still open at the end of the last text
    return at[here]


class Merges:
    """Ranks of a vocabulary, and the pieces merged so far."""

    def __init__(self, path: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
        self.cache: dict[bytes, list[int]] = {}

    def ids(self, piece: bytes) -> list[int]:
        if (known := self.cache.get(piece)) is not None:
            return known
        whole = self.ranks.get(piece)
        found = [whole] if whole is not None else self._merged(piece)
        if len(piece) <= LONGEST:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[piece] = found
        return found

    def _merged(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if not end[i] or j >= n or end[j] != to:
                continue  # one of the two has been merged since
            end[i], end[j], after[i] = to, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:to])) is not None:
                heapq.heappush(heap, (r, h, to))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out


@lru_cache(2)
def merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(2)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens laid end to end, and where each begins, by id, with one more."""
    ranks = merges(path).ranks
    words = [b""] * (max(ranks.values(), default=-1) + 1)
    for word, i in ranks.items():
        words[i] = word
    return np.frombuffer(b"".join(words), np.uint8), np.append(0, np.cumsum([len(w) for w in words])).astype(np.int64)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of slices, one slice after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), ends (the byte after each token in the text's UTF-8)."""

    def run(batches):
        merge, sizes = merges(path), np.diff(vocabulary(path)[1])
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            for lo, hi in chunks(offsets, CHUNK):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts = piece_starts(part, at)
                cuts = pa.py_buffer(np.append(starts, len(part)).astype(np.int64))
                pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, cuts, pa.py_buffer(np.ascontiguousarray(part))]).dictionary_encode()
                found = [merge.ids(p) for p in pieces.dictionary.to_pylist()]
                counts = np.array([len(x) for x in found], np.int64)
                flat = np.fromiter((i for x in found for i in x), np.uint32, int(counts.sum()))
                which = pieces.indices.to_numpy()
                ids = flat[spread((np.cumsum(counts) - counts)[which], counts[which])]
                ends = np.cumsum(sizes[ids])  # tokens tile the chunk, and pieces never cross texts
                rows = np.searchsorted(ends, at, "right")
                n = np.diff(rows)
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(4 * rows.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                ends = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array((ends - np.repeat(at[:-1], n)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n.astype(np.int64)), ids.cast(pa.binary()), ends], names=["doc_id", "n_tokens", "ids", "ends"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, ends array<int>")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """The rows of encoded() with data, the bytes of the tokens, each put where its offset says."""

    def run(batches):
        words, begins = vocabulary(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = np.concatenate([np.frombuffer(x, "<u4") for x in part.column("ids").to_pylist()] or [np.zeros(0, np.uint32)]).astype(np.int64)
                counts, ends = pc.list_value_length(part.column("ends")).to_numpy(), part.column("ends").flatten().to_numpy()
                last = np.cumsum(counts)
                sizes = np.zeros(len(counts), np.int64)
                sizes[counts > 0] = ends[last[counts > 0] - 1]
                at = np.append(0, np.cumsum(sizes))
                lengths = begins[ids + 1] - begins[ids]
                out = np.zeros(at[-1], np.uint8)
                out[spread(np.repeat(at[:-1], counts) + ends - lengths, lengths)] = words[spread(begins[ids], lengths)]
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([*part.columns, data.cast(pa.binary())], names=[*part.schema.names, "data"])

    return tokens.mapInArrow(run, "doc_id long, n_tokens long, ids binary, ends array<int>, data binary")
