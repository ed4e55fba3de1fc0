"""Small cases against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import zlib
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(5)


def text(n, seed, size=3000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def edited(t, every, seed):
    ws = t.split()
    for i in range(seed % every, len(ws), every):
        ws[i] = f"x{seed}{i}"
    return " ".join(ws)


BASE = text(300, 1)
LINE = text(30, 2)
SAMPLE = [(1, BASE), (2, BASE), (3, edited(BASE, 70, 3)), (4, edited(BASE, 70, 9)), (5, None), (6, ""), (7, " \n "), (8, "a b"), (9, "A B"), (10, "one two three four five six"), (11, "one two three four five six seven"), (None, BASE), (12, text(4000, 7)), (12, text(4000, 7)), *((20 + i, LINE + " " + text(60, 100 + i)) for i in range(90)), *((200 + i, edited(text(150, 55), 40, i)) for i in range(40))]


def test_jaccard_join(docs):
    from scriptorium.llm.ngram_join import jaccard_components

    sets = {}
    for i, t in SAMPLE:
        w = WORD.findall((t or "").lower())
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = jaccard_components(docs(SAMPLE)).collect()
    assert len(got) == len(SAMPLE)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == (find(r.doc_id) if r.doc_id is not None else find(1))
    assert jaccard_components(docs([])).count() == 0


def test_substring_dedup(docs):
    from scriptorium.llm.substring_dedup import passages

    shared = text(70, 31)
    rows = [(1, text(100, 32) + " " + shared + " " + text(50, 33)), (2, text(80, 34) + " " + shared), (3, edited(shared, 60, 4) + " " + text(90, 35)), (4, text(200, 36)), (5, None), (6, ""), (7, text(60, 37)), (8, text(60, 37)), (None, shared), (9, "short " * 3)]
    got = {}
    for r in passages(docs(rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sorted(got) == [2, 3, 8]
    found = rows[1][1][got[2][0].start : got[2][0].end].split()
    assert set(shared.split()[2:-2]) <= set(found) and len(found) <= 76
    assert got[8][0].source_id == 7 and got[8][0].similarity == 1
    assert passages(docs([])).count() == 0


def test_decontamination(spark, docs):
    from scriptorium.llm.decontamination import leaks

    items = [(i, text(20 + i, 400 + i, 10**6)) for i in range(20)] + [(50, None), (51, "too short")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, text(100, 500 + i) + ". " + edited(t, 8, i).upper() + " " + text(50, 600 + i)) for i, t in items[:20]] + [(90, text(300, 9)), (91, None), (92, "")]
    got = {(r.doc_id, r.item_id) for r in leaks(docs(rows), bench).collect()}
    assert got <= {(i, i) for i in range(20)} and len(got) >= 18
    assert leaks(docs([]), bench).count() == 0 and leaks(docs(rows), bench.limit(0)).count() == 0


def test_warc(spark):
    from scriptorium.llm import warc

    long = "é" * 80
    pages = [(3, "http://a", long), (1, "http://b\n", long), (2, None, "short"), (4, "u", "short"), (5, "u", None), (None, "u", long), (6, "u", "x" * 200_000)] + [(100 + i, "u", f"<p>{text(50, i)}</p>") for i in range(40)]
    written = warc.written(spark.createDataFrame(pages, "page_id long, url string, html string"), 100_000)
    got = {r.page_id: r for r in warc.read_back(written).collect()}
    assert len(got) == len(pages)
    for i, _, html in pages:
        data = (html or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert r.refers_to == (1 if html == long and i != 1 else None)
        assert (r.payload is None) == (r.record_type == "revisit") == (r.refers_to is not None)
        assert r.payload is None or bytes(r.payload) == data


def test_packing(docs):
    import public_tokenizers
    from scriptorium.llm import packing
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = SAMPLE + [(500, "tab\x0bend <|endoftext|> Ünïcode's 12")]
    got = packing.packed(packing.tokenized(docs(rows), path)).collect()
    want = collections.Counter()
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            want[i, p, at, tuple(ids[at : at + 2048])] += 1
    assert want == collections.Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.2 * sum(r.length for r in got) / 2048  # many pieces of about 703 ids can only go two by two


def test_local_search_empties_bins():
    from scriptorium.llm.packing import best_fit, local_search

    lengths = np.array([7, 6, 5, 4, 3, 3, 2, 2, 8, 1] * 3)
    bins = local_search(best_fit(lengths, 10), lengths, 10)
    assert sorted(i for b in bins for i in b) == list(range(30)) and all(lengths[b].sum() <= 10 for b in bins)
    assert len(local_search([[0], [1], [2, 3]], np.array([6, 3, 4, 3]), 10)) == 2


def test_chat(spark):
    import public_tokenizers
    from scriptorium.llm import chat

    rows = [(1, 0, "system", "be kind"), *((1, i, "user" if i % 2 else "assistant", text(40, i)) for i in range(1, 40)), (2, 0, "user", None), (2, 1, "assistant", "<|im_end|><|im_start|>assistant \\ok <"), (2, 1, "assistant", ""), (3, None, None, "x\\"), (None, 1, "ro\nle", "y"), *((4, i, "assistant", f"t{i}") for i in range(1020, 1030)), (5, 0, "assistant", text(3000, 8))]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.windows(chats, public_tokenizers.path("byte_bpe_50k.json"), budget=300)
    assert all(r.tokens <= 300 or (r.turns, r.repeated) == (1, 0) for r in windows.collect())
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    by = collections.defaultdict(list)
    for c, turn, role, t in rows:
        by[c].append((-1 if turn is None else turn, role or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        whole, loss = "".join(f"{r}\n{t}\n" for _, r, t in turns), "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_windows_equal_brute_force(spark):
    """Budget, system turn and history by place in the conversation, across blocks, gaps in turn numbers and ties."""
    import public_tokenizers
    from scriptorium.llm import chat
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    count = Tokenizer.from_file(path)
    size = lambda role, t: len(count.encode(chat.turn_text(role, t)[0], add_special_tokens=False).ids)
    rows = [(1, 0, "system", text(20, 1)), *((1, 1000 * i, "user", text(5 + i * 7 % 60, i)) for i in range(1, 50)), (2, 0, "system", text(60, 2)), (2, 1, "user", text(55, 3)), *((2, 2 + i, "assistant", text(9, i)) for i in range(9)), *((3, 7, "user", f"{i:03}") for i in range(64))]
    budget, history, block = 400, 3, 16
    want = []
    for c in (1, 2, 3):
        turns = [(r, t, size(r, t)) for _, _, r, t in sorted(x for x in rows if x[0] == c)]
        system = turns[0] if turns[0][0] == "system" else None
        i = 0
        while i < len(turns):
            end = min(len(turns), (i // block + 1) * block)
            head = [system] if system and i else []
            alone = bool(head) and head[0][2] + turns[i][2] > budget
            head, back = [] if alone else head, []
            room = budget - sum(x[2] for x in head)
            most = 0 if alone else min(budget // 2, room - turns[i][2])
            for turn in reversed(turns[max(i - history, 1 if system else 0) : i]):
                if turn[2] > most:
                    break
                most, back = most - turn[2], [turn, *back]
            room, j = room - sum(x[2] for x in back), i
            while j < end and (j == i or sum(x[2] for x in turns[i : j + 1]) <= room) and not (alone and j > i):
                j += 1
            want.append((c, len(head) + len(back), [x[:2] for x in head + back + turns[i:j]]))
            i = j
    chats = spark.createDataFrame([(*x, 0, "x") for x in rows], "conv_id long, turn long, role string, text string, tokens int, place string")
    got = chat.windows(chats, path, budget, history, block).orderBy("conv_id", "block", "window").collect()
    assert [(r.conv_id, r.repeated, chat.turns_of(r.text)) for r in got] == want
    assert all(r.tokens == sum(size(*x) for x in chat.turns_of(r.text)) for r in got)
    assert chat.digests(chat.windows(chats.limit(0), path)).count() == 0


def test_language_replaces_columns_and_learns_every_language(spark, monkeypatch):
    from scriptorium.llm import language_id as L

    monkeypatch.setattr(L, "SAMPLE", 20)  # fewer than EACH for a language
    alphabets = {f"l{k}": "".join(chr(0x61 + 3 * k + j) for j in range(3)) for k in range(8)}
    rows = [(100 * k + i, " ".join("".join(random.Random(100 * k + i + w).choices(a, k=6)) for w in range(0, 90, 3)), lang, 7, "old") for k, (lang, a) in enumerate(alphabets.items()) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, lang_pred string")
    got = L.with_language(docs, L.fit(docs)).collect()
    assert len(got) == len(rows) and all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)
    assert got[0].__fields__ == ["doc_id", "text", "lang", "lang_pred", "score"]


def test_decontamination_short_items_and_distances(spark, docs):
    from scriptorium.llm.decontamination import Index, allowed, leaks, runs, words

    items = [(1, "zebra"), (2, "blue zebra"), (3, "one two three four"), (4, "alpha beta gamma delta epsilon"), (5, "?!"), (6, "Zebra"), (7, text(15, 3, 10**6)), (8, text(40, 4, 10**6)), (9, text(40, 4, 10**6))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "a blue Zebra."), (2, "zebras blue"), (3, "x one, two three FOUR y"), (4, "one two four three"), (5, "alpha beta gamma delta epsilon"), (None, "zebra"), (6, text(20000, 5)), (7, "so " + edited(items[6][1], 6, 2)), *((10 + k, text(30, 60 + k) + " " + edited(items[7][1], 6, k) + " " + text(30, 80 + k)) for k in range(6))]
    rows.append((7, rows[7][1]))

    def distance(item, text):  # the closest passage
        row = [0] * (len(text) + 1)
        for i, p in enumerate(item):
            new = [i + 1]
            for j, w in enumerate(text):
                new.append(min(row[j] + (p != w), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    want = collections.Counter()
    for d, t in rows:
        for i, item in items:
            p = words(item)
            if p and len(words(t)) < 5000 and (n := distance(p, words(t))) <= (allowed(len(p)) if len(p) >= 5 else 0):
                want[d, i, n] += 1
    got = collections.Counter((r.doc_id, r.item_id, r.distance) for r in leaks(docs(rows), bench).collect())
    assert got == want and want[10, 8, 7] == 1 and want[1, 6, 0] == 1
    many = np.array([[3_000_001, 3_000_002, 3_000_003], [1, 2, 3], [1, 0, 3]])
    assert [bool(x >= 0) for x in runs(many, 3)[:, 0]] == [True, True, False]
    assert not Index([]).exact(np.array([1, 2]))


def test_language(spark):
    from scriptorium.llm import language_id as L

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(-1, None, "en"), (-2, "12 !", None), (-3, "", "de"), (None, "le et", "fr")], docs.schema))
    model = L.fit(docs.where(L.fold(3) != 1))
    got = L.with_language(docs, model).collect()
    assert {r.lang_pred for r in got if r.doc_id in (-1, -2, -3)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id >= 0 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert {r.lang_pred for r in L.with_language(docs, L.fit(docs.limit(0))).collect()} == {"und"}


def test_hmm(docs):
    from scriptorium.llm import hmm

    rows = [(i, t) for i, t in SAMPLE if i is None or i < 60]
    got = hmm.scores(docs(rows).withColumn("held_out", F.col("doc_id").isin(3, 8))).collect()
    tokens = lambda t: [*WORD.findall((t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))), "\n"]
    counts = collections.Counter()
    for i, t in rows:
        if i not in (None, 3, 8):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            continue
        ts = tokens(dict(rows)[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(counts[t] > 0 for t in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts))
        assert r.score < 0
    by = {r.doc_id: r.score for r in got}
    assert by[1] == pytest.approx(by[2]) and by[5] == pytest.approx(by[6])
    assert hmm.scores(docs([]).withColumn("held_out", F.lit(False))).count() == 0
    untrained = hmm.scores(docs(rows[:3]).withColumn("held_out", F.lit(True))).collect()
    assert [(r.n_known, r.train_tokens) for r in untrained] == [(0, 0)] * 3


def test_hmm_tells_long_words_of_two_letters_apart(docs):
    from scriptorium.llm import hmm

    x, y = "a", "b"
    for _ in range(11):
        x, y = x + y, y + x
    got = {r.doc_id: r for r in hmm.scores(docs([(1, x), (2, f"{x} c"), (3, y)]).withColumn("held_out", F.col("doc_id") == 3)).collect()}
    assert [got[i].n_known for i in (1, 2, 3)] == [2, 3, 1]
    got = hmm.scores(docs([(1, x), (2, y)]).withColumn("held_out", F.lit(False))).collect()
    assert all(r.base_score == pytest.approx(math.log10(1.1 / 4.4) + math.log10(2.1 / 4.4)) for r in got)


def test_hmm_counts_equal_a_sum_over_paths():
    from scriptorium.llm import hmm

    rng = np.random.default_rng(0)
    model = hmm.first_model(rng.dirichlet(np.ones(5)), 3)
    model["start"] = np.array([0.5, 0.3, 0.2])
    texts = [[0, 4, 3, 1], [1, 2]]
    x = np.array([[0, 1], [4, 2], [3, -1], [1, -1]], np.int32)
    emissions, moves, starts = np.zeros((3, 5)), np.zeros((3, 3)), np.zeros(3)
    logs = []
    for ids in texts:
        paths = {}
        for path in itertools.product(range(3), repeat=len(ids)):
            p = model["start"][path[0]] * model["emit"][path[0], ids[0]]
            for (a, b), i in zip(zip(path, path[1:]), ids[1:]):
                p *= model["move"][a, b] * model["emit"][b, i]
            paths[path] = p
        whole = sum(paths.values())
        logs.append(math.log10(whole))
        for path, p in paths.items():
            starts[path[0]] += p / whole
            for s, i in zip(path, ids):
                emissions[s, i] += p / whole
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / whole
    got = hmm.expected(x, np.array([4, 2]), model)
    for a, b in zip(got, (emissions, moves, starts)):
        assert np.allclose(a, b, atol=1e-5)
    assert np.allclose(hmm.forward(x, np.array([4, 2]), model)[0], logs, atol=1e-5)


def test_hmm_scores_equal_a_plain_pass_over_the_trained_emissions(docs, monkeypatch):
    """Every trained token has emissions of its own; blocks don't change scores."""
    from scriptorium.llm import hmm

    rows = [(i, text(30 + i, i, 40)) for i in range(12)]
    frame = docs(rows).withColumn("held_out", F.col("doc_id") == 3)
    scores = {r.doc_id: r.score for r in hmm.scores(frame).collect()}
    kept = {}
    monkeypatch.setattr(hmm, "_scored", lambda *a: kept.update(args=a))
    hmm.scores(frame)
    _, table, model, share, norm, total, base_of = kept["args"]
    emissions = {}
    for r in table.collect():
        c = np.array([r[k] / hmm.FINE for k in hmm.COLUMNS])
        c = np.maximum(np.append(c, r.n - c.sum()), 0)
        emissions[r.token] = (r.n + 0.1) / base_of * (c / share + hmm.SMOOTH) / (r.n + hmm.SMOOTH) / norm
    assert np.allclose(sum(emissions.values()) + 0.1 / base_of / norm, 1)
    for i, t in rows:
        vocabulary, place, _ = hmm.tokens(pa.array([t]))
        a = np.array(model["start"])
        for k, token in enumerate(vocabulary[place]):
            e = emissions.get(token, 0.1 / base_of / norm)
            a = (a @ model["move"] if k else a) * e
        assert scores[i] == pytest.approx(math.log10(a.sum()), rel=1e-5)


def test_quality_rules(docs):
    from scriptorium.llm.quality_rules import rules

    rows = [*((i, text(80 + i % 50, i)) for i in range(150)), (900, " ".join(w + "###" for w in text(100, 3).split())), (901, None), (902, ""), (903, "a b c\n" * 40), (None, text(90, 4)), (904, text(90, 4))]
    got = {r.doc_id: r for r in rules(docs(rows)).collect()}
    for i, t in rows:
        w = WORD.findall(t or "")
        seen = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        again = {j + k for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert (got[i].n_words, got[i].word_chars, got[i].n_dup_lines, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(again))
        assert got[i].base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
    assert sum(got[i].kept for i in range(150)) >= 147 and not got[900].kept and not got[901].kept
    assert rules(docs([])).count() == 0


def test_outliers_equal_a_plain_search_of_the_least_determinant(spark):
    """Estimates against concentration steps from many random starts in numpy; small groups are judged as large ones."""
    from scriptorium.llm import quality_rules as Q

    rng = np.random.default_rng(3)
    mix = rng.normal(size=(5, 5)) / 3 + np.eye(5)
    x = rng.normal(size=(600, 5)) @ mix
    x[:90] += 25 * rng.choice([-1, 1], (90, 5))
    rows = [(i, "en", "big", False, *map(float, v)) for i, v in enumerate(x)]
    rows += [(1000 + i, "en", f"small{n}", False, *map(float, v)) for n in (1, 5, 90) for i, v in enumerate([*(rng.normal(size=(n - n // 5, 5)) @ mix), *([[30.0] * 5] * (n // 5))])]
    rows += [(2000, None, None, False, *map(float, x[100])), (2001, "en", "none", True, *[500.0] * 5)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, source string, base_failed boolean, x0 double, x1 double, x2 double, x3 double, x4 double")
    found = {r.key: r for r in Q.estimates(frame.where("source = 'big'").select(F.lit("k").alias("key"), *Q.X)).collect()}["k"]
    best = (math.inf, None)
    for _ in range(30):
        some = rng.choice(600, 6, replace=False)
        for _ in range(30):
            c = np.cov(x[some].T, bias=True) + np.diag(np.square(Q.FLOOR))
            d = np.einsum("ij,jk,ik->i", x - x[some].mean(0), np.linalg.inv(c), x - x[some].mean(0))
            some = np.argsort(d, kind="stable")[: int(Q.KEEP * 600)]
        c = np.cov(x[some].T, bias=True) + np.diag(np.square(Q.FLOOR))
        best = min(best, (np.linalg.slogdet(c)[1], tuple(np.append(x[some].mean(0), c[np.tril_indices(5)]))))
    got = [found[m] for m in Q.MOMENTS[1:]]
    assert np.allclose(got, best[1], atol=0.12), np.abs(np.array(got) - best[1]).max()
    far = {(r.source, r.doc_id): r.distance for r in Q.judged(frame).collect()}
    assert all((far["big", i] > Q.CUT) == (i < 90) for i in range(600))
    for n in (5, 90):
        assert all((far[f"small{n}", 1000 + i] > Q.CUT) == (i >= n - n // 5) for i in range(n))
    assert far["small1", 1000] <= Q.CUT and far[None, 2000] <= Q.CUT


def test_weak_labels(spark):
    from scriptorium.llm import weak_labels as L

    q, _ = L.posteriors(np.array([[0, 0, -1], [1, 1, 1], [-1, 1, 0], [-1, -1, -1]]), np.array([20.0, 60.0, 5.0, 10.0]))
    assert q[0] < 0.1 < 0.9 < q[1]
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (None, "a b")], "doc_id long, text string"))
    got = {r.doc_id: r for r in L.judged(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = [r for r in labels.where("doc_id % 2 = 1").collect()]
    assert -1 in got and None in got
    assert sum((got[r.doc_id].quality_score >= 0.5) == (r.quality == 1) for r in held) >= 0.85 * len(held)


def spans_of(x, y, a, b):
    """Brute force, for texts of distinct words edited in place: whether a span around x[a] = y[b] has fifty words and the similarity."""
    s = np.array([u == v for u, v in zip(x, y)])
    c = np.append(0, np.cumsum(s))
    n = len(s)
    return any(9 * (c[j + 1] - c[i]) >= 8 * (j - i + 1) for i in range(a + 1) for j in range(max(a, i + 45), n))


def test_substring_spans_cross_edits():
    from scriptorium.llm.substring_dedup import _Partners

    def shingled(ws):
        return np.array([hash(tuple(ws[i : i + 5])) & (1 << 62) - 1 for i in range(len(ws) - 4)], np.uint64)

    found = 0
    for n in (50, 55, 60, 65, 70, 100, 120):
        inner = [f"p{i}" for i in range(n)]
        doubles = [(u, v) for u in range(3, n, 17) for v in range(u + 1, n, 13)]
        for edits in [(u,) for u in range(n)] + doubles:
            other = [f"e{i}" if i in edits else w for i, w in enumerate(inner)]
            x = shingled([f"a{i}" for i in range(20)] + inner + [f"b{i}" for i in range(20)])
            y = shingled([f"c{i}" for i in range(20)] + other + [f"d{i}" for i in range(20)])
            anchors = [int(p) for p in np.flatnonzero(x == y)]
            for a in {anchors[0], anchors[len(anchors) // 2], anchors[-1]}:
                got = _Partners(x, y).spans(a, a)
                assert bool(got) == spans_of(x, y, a, a), (n, edits, a)
                found += bool(got)
                if got:
                    assert got[0] <= a <= got[1] and got[1] - got[0] >= 45 and got[2] >= 0.8
    assert found > 1000


def test_substring_dedup_reports_every_place(docs):
    from scriptorium.llm.substring_dedup import passages

    shared = text(60, 71)
    parts = [text(30, 72), shared, text(90, 73), shared, text(40, 74), edited(shared, 60, 31), text(30, 75)]
    rows = [(1, text(50, 76) + " " + shared + " " + text(50, 77)), (2, " ".join(parts))]
    got = sorted((r.first_word, r.last_word) for r in passages(docs(rows)).collect())
    assert got == [(30, 89), (180, 239), (280, 339)]


def test_substring_dedup_pairs_beyond_leaders(docs):
    from scriptorium.llm.substring_dedup import passages

    line = text(44, 81, 10**6)
    tails = [text(3, 800 + k, 10**6) for k in range(8)]
    alone = [(i, text(30, 900 + i, 10**6) + " " + line + " " + text(30, 1000 + i, 10**6)) for i in range(60)]
    twins = [(100 + i, text(30, 1100 + i, 10**6) + " " + line + " " + tails[i // 2] + " " + text(30, 1200 + i, 10**6)) for i in range(16)]
    assert {(r.doc_id, r.source_id) for r in passages(docs(alone + twins)).collect()} == {(101 + i, 100 + i) for i in range(0, 16, 2)}
