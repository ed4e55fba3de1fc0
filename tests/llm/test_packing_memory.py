"""What a worker tokenises at a time, and that all of every text comes out, whatever the parts."""

import numpy as np
import pyarrow as pa

from scriptorium.llm import packing


def test_a_worker_holds_few_texts_at_a_time(spark, monkeypatch):
    sizes, held = [], {}
    frame = type("Frame", (), {"select": lambda self, *_: self, "mapInArrow": lambda self, run, _: held.update(run=run)})()

    def word_ids(_):
        def encode(texts):
            texts = texts.to_pylist()
            sizes.append((sum(map(len, texts)), len(texts)))
            return np.concatenate([np.full(len(t) // 100, 7, np.uint32) for t in texts]), np.array([len(t) // 100 for t in texts])

        return encode

    monkeypatch.setattr(packing, "word_ids", word_ids)
    packing.tokenized(frame, "tokenizer")
    texts = ["x" * 300_000] * 40 + ["y" * 9_000_000, ""]
    rows = [r for b in held["run"]([pa.RecordBatch.from_pydict({"doc_id": list(range(42)), "text": texts})]) for r in b.to_pylist()]
    assert all(size <= 2 << 20 or n == 1 for size, n in sizes)
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + r["ids"]
    assert got == {i: np.array([7] * (len(t) // 100) + [0], "<u4").tobytes() for i, t in enumerate(texts)}


def test_a_worker_tokenises_a_megabyte_and_remembers_few_words(monkeypatch):
    assert packing.PART <= 1 << 20 and packing.WORDS <= 300_000
    import public_tokenizers

    monkeypatch.setattr(packing, "WORDS", 10)
    monkeypatch.setattr(packing, "_KNOWN", {})
    encode = packing.word_ids(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["one two three four five six seven eight nine ten eleven twelve", "eleven Twelve, thirteen one"]
    first = [encode(pa.array([t]))[0].tolist() for t in texts * 2]
    assert first[:2] == first[2:] and len(next(iter(packing._KNOWN.values()))) <= 10 + 12 + 1


def test_a_task_leaves_no_words_and_words_encoded_together_keep_their_ids(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, held = public_tokenizers.path("word_bpe_49k.json"), {}
    frame = type("Frame", (), {"select": lambda self, *_: self, "mapInArrow": lambda self, run, _: held.update(run=run)})()
    monkeypatch.setattr(packing, "_KNOWN", {})
    packing.tokenized(frame, path)
    texts = ["It's 1234 O'Neil's", "a<|endoftext|>b <|startoftext|> c", "   x́y ́ ﻿", "​ \x00 \U0001f600‍\U0001f600", "", "ﬁ İ ß don't...   z"]
    rows = [r for b in held["run"]([pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})]) for r in b.to_pylist()]
    tokenizer = Tokenizer.from_file(path)
    want = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]
    assert [r["ids"] for r in rows] == want
    assert not packing._KNOWN
