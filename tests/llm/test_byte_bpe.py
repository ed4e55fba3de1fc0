"""Byte-level BPE against the library whose ranks it uses."""

import hashlib
import random

import numpy as np
import pytest

RNG = random.Random(9)
SIGNS = ["'", "'", "s", "t", "r", "e", "v", "m", "l", "d", "L", "a", " ", " ", "\n", "\t", "1", "!", "é", "\xa0", "日", "²", "́", "\U0001f600", "\x00", "　", "٠"]
MIXED = ["".join(RNG.choice(SIGNS) for _ in range(RNG.randrange(14))) for _ in range(3000)]
LONG = ["a" * 20_000, "ab" * 9_000 + " ", " " * 5_000 + "x", "word's " * 30_000, "日本語" * 4_000, "<|endoftext|> we'll'", "'re", "x'l", " 'v"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    from scriptorium.llm import byte_bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert byte_bpe.PATTERN == public_tokenizers.PATTERN
    return path, tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=byte_bpe.merges(path).ranks, special_tokens={})


def test_pieces(library):
    """The automaton cuts where the pattern does, in texts laid end to end."""
    import regex

    from scriptorium.llm.byte_bpe import PATTERN, piece_starts

    pattern = regex.compile(PATTERN)
    for lo in range(0, len(MIXED), 37):
        some = MIXED[lo : lo + 37]
        parts = [t.encode() for t in some]
        at = np.append(0, np.cumsum([len(p) for p in parts]))
        want = [a + len(t[: m.start()].encode()) for t, a in zip(some, at) for m in pattern.finditer(t)]
        assert piece_starts(np.frombuffer(b"".join(parts), np.uint8), at).tolist() == want


def test_products_are_associative():
    from scriptorium.llm.byte_bpe import CLASSES, automaton

    functions, products, _ = automaton()
    for i, f in enumerate(functions):
        for kind in range(2 * CLASSES):
            assert (functions[products[i, kind]] == functions[kind][f]).all()


def test_encoded_and_decoded(docs, library):
    from scriptorium.llm.byte_bpe import decoded, encoded

    path, own = library
    texts = [*MIXED, *LONG, None, "", " "]
    rows = [*enumerate(texts), (0, MIXED[0]), (None, "null's id")]
    got = {}
    for r in decoded(encoded(docs(rows), path), path).collect():
        got.setdefault((r.doc_id, bytes(r.data)), []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        ends = np.cumsum([len(own.decode_single_token_bytes(x)) for x in ids]).tolist()
        for r in got[i, (t or "").encode()]:
            assert (r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.ends) == (len(ids), ids, ends)
    assert encoded(docs([]), path).count() == 0


def test_query(spark, library):
    from scriptorium.llm.queries import op12_byte_bpe

    _, own = library
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {r.doc_id: (len(ids := own.encode_ordinary(r.text or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op12_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert got == want
