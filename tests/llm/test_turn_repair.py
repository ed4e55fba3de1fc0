"""Repair of conversations against all edits of short ones and a walk over long ones."""

import collections
import hashlib
import itertools
import random
import re
import zlib

SOLID = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def judged(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = SOLID.findall(text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def walk(rows):
    """(cost, audit, roles and texts) by a walk over rows and states, all insertions tried at each place."""
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(best):
        for _ in range(3):
            for q, (cost, audit, said) in list(best.items()):
                for name in ("user", "assistant"):
                    if (q, name[0]) in moves:
                        r, more = moves[q, name[0]], (cost + 2, audit + "I", [*said, (name, "")])
                        best[r] = min(best.get(r, more), more, key=lambda x: x[:2])
        return best

    best = inserted({0: (0, "", [])})
    for role, text, fault in rows:
        into = {}
        for q, (cost, audit, said) in best.items():
            ways = [(q, (cost + 3, audit + "D", said))]
            if fault not in ("blank", "duplicate"):
                late = int(fault == "truncated")
                for letter, name, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if (q, name[:1]) in moves:
                        ways.append((moves[q, name[:1]], (cost + late + price, audit + letter, [*said, (name, text)])))
            for r, way in ways:
                into[r] = min(into.get(r, way), way, key=lambda x: x[:2])
        best = inserted(into)
    return min((best[q] for q in (0, 3) if q in best), key=lambda x: x[:2])


def every(rows):
    """The same by trying all edits, with up to three insertions."""
    found = []

    def go(left, cost, audit, roles, new):
        if not left and re.fullmatch("(s?(ua)+)?", "".join(roles)):
            found.append((cost, audit))
        if new < 3:
            for r in "ua":
                go(left, cost + 2, audit + "I", [*roles, r], new + 1)
        if left:
            role, _, fault = left[0]
            go(left[1:], cost + 3, audit + "D", roles, new)
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                go(left[1:], cost + late, audit + "K", [*roles, role[:1] or "?"], new)
                for r in "ua":
                    go(left[1:], cost + late + 2, audit + "R", [*roles, r], new)

    go(rows, 0, "", [], 0)
    return min(found)


def expected(rows):
    convs, out = collections.defaultdict(list), {}
    for row in damage(rows):
        convs[row[0]].append(row)
    for conv in {r[0] for r in rows}:
        own = sorted(convs[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        marked = judged(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, said = walk(marked)
        if len(marked) <= 3:
            assert (cost, audit) == every(marked)
        count = collections.Counter(m[2] for m in marked)
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())
    return out


RNG = random.Random(4)


def chat(conv, n):
    text = lambda: RNG.choice(["Yes.", "No!", "So what?  ", "cut", "", " \n", "é. ", "ok. but", None, f"t{RNG.randrange(9)}."])
    return [(conv, RNG.choice([i, i, i, i + 1, None]), RNG.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys"]), text()) for i in range(n)]


ROWS = [row for conv in range(300) for row in chat(conv, RNG.randrange(1, 9))]
ROWS += [(None, 0, "user", "Hm."), (None, 1, "assistant", "x" * 100_000 + "!"), (None, 1, "assistant", "x" * 100_000 + "!"), (None, None, None, None)]
ROWS += [(1000, i, "user" if i % 2 == 0 else "assistant", f"Line {i}.") for i in range(1500)] + [(1001, 7, "user", "Same.")] * 200 + chat(1002, 333)
ROWS += [row for conv in range(2000, 2200) for row in [(conv, 0, "user", "Solo?")]]  # some are dropped whole


def got(spark, rows):
    from scriptorium.llm.turn_repair import damaged, report

    chats = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, place long, script string").repartition(5)
    found = report(chats, damaged(chats)).collect()
    assert len(found) == len({r.conv_id for r in found})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}


def test_report(spark):
    want = expected(ROWS)
    assert any(w == (0,) * 6 + ("", hashlib.sha256().hexdigest()) for w in want.values())
    have = got(spark, ROWS)
    assert have.keys() == want.keys()
    for conv in want:
        assert have[conv] == want[conv], conv


def test_empty(spark):
    assert got(spark, []) == {}


def test_repaired_rows(spark):
    from scriptorium.llm.turn_repair import ordered, repaired, scripts, with_faults

    rows = [(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Again."), (1, 2, "system", "Be."), (2, 0, "user", "Hi.")]
    rows = with_faults(ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    fixed = repaired(rows, scripts(rows)).orderBy("conv_id", "place", "number").collect()
    by = lambda c: [(r.role, r.text, r.edit) for r in fixed if r.conv_id == c]
    assert by(1) == [("user", "Hello.", "R"), ("assistant", "Again.", "K")]
    assert by(2) == [("user", "Hi.", "K"), ("assistant", "", "J")]
