"""Chat formatting in budgeted windows that begin and end at turns.

The prefix sums of the turns' tokens, by conversation and block, choose the spans: a window ends before the first turn
whose prefix sum is farther from that of the window's begin than the room beside the system turn, which every window
repeats, and up to `history` earlier turns, which take at most half of the budget. Repeated turns are never targets, so
each assistant text is a target once. A turn that does not fit beside the system turn gets a window without it and
without history; one that alone is over the budget gets a window of its own, whole.

A window also ends at every `block`-th turn of a conversation, counted in its order: conversations of more turns are
formatted block by block in different tasks, with the system turn and the history, which goes by that count, sent along.
Turns are counted within runs of turn numbers, so only equal turn numbers have to be sorted in one task. Rows stream in
order through a task that holds one window.

A turn is <|im_start|>role, a line feed, text and <|im_end|>. Inside roles and texts a backslash is doubled and "<|"
becomes "<\\|" (line feeds in roles "\\n"), so that no text can end a turn, and all is read back as it was.

Cases: null text or role is empty; null conv_id is a conversation; null turns come first; turns with equal numbers go
by role and text; repeated rows are turns of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.shared import keep, small_or_shuffled

BUDGET, HISTORY, BLOCK = 1024, 2, 1024
START, STOP = "<|im_start|>", "<|im_end|>"
WINDOWS = "conv_id long, block long, window int, text string, turns int, repeated int, tokens int, target_starts array<int>, target_ends array<int>"


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], s, flags=re.S)


def turn_text(role: str, text: str) -> tuple[str, int]:
    """A formatted turn, and where its text begins."""
    head = START + escape(role).replace("\n", "\\n") + "\n"
    return head + escape(text) + STOP + "\n", len(head)


def turns_of(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a window."""
    found = []
    for part in text.split(START)[1:]:
        role, _, rest = part.partition("\n")
        found.append((unescape(role), unescape(rest[: rest.rindex(STOP)])))
    return found


def _sized(chats: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, turn, role, text, tokens: the turns without nulls in role or text, and the tokens of each as it is written."""

    def run(batches):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = Tokenizer.from_file(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                turns = zip(part.column("role").to_pylist(), part.column("text").to_pylist())
                sizes = [len(e.ids) for e in count.encode_batch_fast([turn_text(r, t)[0] for r, t in turns], add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes, pa.int64())], names=[*part.schema.names, "tokens"])

    rows = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, tokens long")


def _blocks(chats: DataFrame, history: int, block: int) -> DataFrame:
    """Turns by block: kind 0 is a system turn and kind 1 history from an earlier block, kind 2 the block's own."""
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    long = keep(chats.groupBy(F.col("conv_id").alias("c")).count().where(F.col("count") > block).select("c"), "long")
    own = lambda df, where: df.select("conv_id", "turn", "role", "text", "tokens", where.cast("long").alias("block"), F.lit(2).alias("kind"))
    if long.isEmpty():
        return own(chats, F.lit(0))
    side = small_or_shuffled(long)
    rows = chats.join(side, same).drop("c").withColumn("run", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 60))))
    runs = rows.groupBy(F.col("conv_id").alias("c"), F.col("run").alias("r")).agg(F.count("*").alias("rows"))  # one row for many turns
    runs = runs.withColumn("before", F.sum("rows").over(Window.partitionBy("c").orderBy("r")) - F.col("rows"))
    in_run = F.row_number().over(Window.partitionBy("conv_id", "run").orderBy("turn", "role", "text"))
    rows = rows.withColumn("place", in_run - 1).join(small_or_shuffled(keep(runs, "runs")), same & (F.col("run") == F.col("r")))
    rows = keep(rows.withColumn("place", F.col("place") + F.col("before")).select("conv_id", "turn", "role", "text", "tokens", "place"), "places")
    later = F.floor(F.col("place") / block)
    after = own(rows.where(F.pmod("place", F.lit(block)) >= block - history), later + 1).withColumn("kind", F.lit(1))
    blocks = rows.where((F.col("place") > 0) & (F.pmod("place", F.lit(block)) == 0)).select(F.col("conv_id").alias("c"), later.alias("b"))
    after = after.join(blocks, same & (F.col("block") == F.col("b")), "left_semi")  # a last full block has none after it
    system = rows.where("place = 0 AND role = 'system'").join(blocks, same)
    system = own(system, F.col("b")).withColumn("kind", F.lit(0))
    return own(chats.join(side, same, "left_anti"), F.lit(0)).unionByName(own(rows, later)).unionByName(after).unionByName(system)


class _Writer:
    """Windows of the block that streams by."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history, self.out = budget, history, []

    def begin(self, key):
        self.key, self.system, self.earlier, self.new, self.number = key, None, deque(maxlen=self.history), [], 0

    def add(self, kind: int, role: str, text: str, tokens: int, prefix: int):
        """prefix is the sum of the tokens up to and with this turn."""
        turn = (*turn_text(role, text), role, tokens, len(escape(text)))
        if kind == 0:
            self.system = turn
        elif kind == 1:
            self.earlier.append(turn)
        else:
            first = not self.number and not self.new and self.system is None
            if self.new and prefix - self.begun > self.room:
                self.flush()
            if not self.new:
                self.open(tokens, prefix - tokens)
            self.new.append(turn)
            self.end = prefix
            if first and role == "system":
                self.opening = turn

    opening = None

    def open(self, tokens: int, begun: int):
        self.head = [self.system] if self.system and self.system[3] + tokens <= self.budget else []
        taken = sum(turn[3] for turn in self.head)
        self.repeats, most = [], min(self.budget // 2, self.budget - taken - tokens) if self.head or not self.system else 0
        for turn in reversed(self.earlier):
            if turn[3] > most:
                break
            most -= turn[3]
            taken += turn[3]
            self.repeats.insert(0, turn)
        self.begun, self.taken, self.room = begun, taken, self.budget - taken
        if self.system and not self.head:
            self.room = tokens  # the system turn comes back with the next window

    def flush(self):
        if not self.new:
            return
        head = self.head
        text, starts, ends = "", [], []
        for turn in [*head, *self.repeats]:
            text += turn[0]
        parts, at = [text], len(text)
        for turn in self.new:
            if turn[2] == "assistant":
                starts.append(at + turn[1])
                ends.append(at + turn[1] + turn[4])
            parts.append(turn[0])
            at += len(turn[0])
        self.out.append((*self.key, self.number, "".join(parts), len(head) + len(self.repeats) + len(self.new), len(head) + len(self.repeats), self.taken + self.end - self.begun, starts, ends))
        self.earlier.extend(t for t in self.new if t is not self.opening)
        if self.opening is not None:
            self.system, self.opening = self.opening, None
        self.new, self.number = [], self.number + 1


def windows(chats: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY, block: int = BLOCK) -> DataFrame:
    """Windows of chats (conv_id, turn, role, text), with the code points of their targets. history is at most block."""

    def run(batches):
        writer, now = _Writer(budget, history), None
        schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("turns", pa.int32()), ("repeated", pa.int32()), ("tokens", pa.int32()), ("target_starts", pa.list_(pa.int32())), ("target_ends", pa.list_(pa.int32()))])

        def batch_out():
            out, writer.out = writer.out, []
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                for conv, number, *turn in zip(*batch.slice(lo, 512).to_pydict().values()):
                    if now != (conv, number):
                        if now is not None:
                            writer.flush()
                        now = (conv, number)
                        writer.begin(now)
                    writer.add(*turn)
                yield batch_out()
        if now is not None:
            writer.flush()
            yield batch_out()

    if not 0 <= history <= block:
        raise ValueError("history is from 0 to block")
    order = ["kind", "turn", "role", "text"]
    rows = _blocks(keep(_sized(chats, tokenizer), "turns"), history, block).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", *order)
    prefix = F.sum(F.when(F.col("kind") == 2, F.col("tokens")).otherwise(0)).over(Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("conv_id", "block", "kind", "role", "text", "tokens", prefix.alias("prefix")).mapInArrow(run, WINDOWS)


def digests(found: DataFrame) -> DataFrame:
    """What windows hold, read back from their texts, by conversation. A digest needs a conversation's windows in
    order, so these stream through one task, which keeps only the state of two hashes."""

    def run(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        now, state = None, None

        def done():
            return {"conv_id": now[0], "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if now is None or now[0] != row["conv_id"]:
                    if now is not None:
                        out.append(done())
                    now, state = (row["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in turns_of(row["text"])[row["repeated"] :]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for x, y in zip(row["target_starts"], row["target_ends"]):
                    target = unescape(row["text"][x:y])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(row["text"])
            yield pa.RecordBatch.from_pylist(out, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([done()], schema)

    rows = found.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window")
    return rows.select("conv_id", "text", "repeated", "target_starts", "target_ends").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
