"""Repair of the order of roles in conversations, by a weighted parse of intervals.

A repaired conversation has role initials (s?(ua)+)?. Its automaton has four states: 0 nothing said, 1 after the system
turn, 2 after a user turn, 3 after an assistant turn; 0 and 3 may end. In Chomsky normal form a nonterminal X_pr stands
for the roles that lead from state p to state r, X_pr -> X_pq X_qr for every q. A cell is the cheapest (cost, script) by
which the rows of a span become a word of X_pr; a script has a letter for each edit, in order:

    D delete, I insert user, J insert assistant, K keep, R rerole to user, S rerole to assistant

Insertions come before a row (the unary rules' closure, worked out once in LEAVES) or after the last. Spans are aligned
at powers of two, and every round joins a span to its right neighbour and takes the least of all q: as any split of a
span gives the same cell, one is enough. A conversation of n rows takes log2(n) rounds, each a shuffle by conversation
and span; no task ever holds a conversation. Of two scripts over the same rows at equal cost none begins the other, since
the letters decide the cost, so the least of a span is made of the least of its halves; and I and J, like R and S, are
told by the state, so that the order of scripts is that of audits, in which J reads I and S reads R.

Cases: null roles and texts are one space; a null conv_id is a conversation; null turns come first, rows of equal turns
go by role and text, and equal rows count apart. Conversations without rows have no repaired rows, cost 0 and an empty
script. An empty table gives no rows. Very long texts are compared whole. Other columns are dropped.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.shared import keep

SOLID = r"[^\x20\x09-\x0D]"
#: Where each role leads from each state.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The scripts that insert, by states: the shortest are the cheapest.
INSERTED = {(0, 0): "", (1, 1): "", (2, 2): "", (3, 3): "", (0, 2): "I", (0, 3): "IJ", (1, 2): "I", (1, 3): "IJ", (2, 3): "J", (3, 2): "I"}
#: The nonterminals that derive anything: pairs of states one of which can be reached from the other.
PAIRS = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
CELL = "struct<cost:long,script:string>"


def _leaf(role: str, fault: str) -> dict[tuple[int, int], tuple[int, str]]:
    """The cells of one row, insertions before it included."""
    late = int(fault == "truncated")
    cells = {}
    for (p, q), before in INSERTED.items():
        edits = [("D", q, 3)]
        if fault not in ("blank", "duplicate"):
            edits += [(letter, MOVES[q, to], cost + late) for letter, to, cost in (("K", role, 0), ("R", "u", 2), ("S", "a", 2)) if (q, to) in MOVES]
        for letter, r, cost in edits:
            cell = (2 * len(before) + cost, before + letter)
            cells[p, r] = min(cells.get((p, r), cell), cell)
    return cells


def ordered(chats: DataFrame) -> DataFrame:
    """conv_id, place (from 0), turn, role, text of all rows, places given by turn, role and text, in any number of tasks.

    Rows are dealt out by ranges of conversation, turn, role and the first 64 characters of the text, so that a long
    conversation, or a turn number that all its rows share, takes many tasks; a row's place is its place in its range
    and the rows of the conversation in ranges before.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    rows = rows.repartitionByRange("conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = keep(rows.withColumn("id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("id", 33)
    runs = rows.groupBy("conv_id", part.alias("part")).agg(F.min("id").alias("first"), F.count("*").alias("rows"))  # one row for each task that has some
    by_part = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "part", F.coalesce(F.sum("rows").over(by_part), F.lit(0)).alias("before"), "first")
    runs = runs.toDF("c", "p", "before", "first")
    placed = rows.join(runs, F.col("conv_id").eqNullSafe(F.col("c")) & (part == F.col("p")))
    return placed.select("conv_id", (F.col("id") - F.col("first") + F.col("before")).alias("place"), "turn", "role", "text")


def with_faults(rows: DataFrame) -> DataFrame:
    """The rows of ordered() with fault: blank, duplicate, truncated or empty, the first that holds."""
    again = rows.groupBy("conv_id", "role", "text").agg(F.min("place").alias("seen"), F.count("*").alias("rows")).where("rows > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t"), "seen")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t"))
    fault = F.when(~F.col("text").rlike(SOLID), "blank").when(F.col("place") > F.col("seen"), "duplicate")
    fault = fault.when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("")
    return rows.join(again, same, "left").select("conv_id", "place", "turn", "role", "text", fault.alias("fault"))


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def _joined(left: str, right: str) -> Column:
    """A cell of two neighbours, null where one is."""
    both = F.struct((F.col(f"{left}.cost") + F.col(f"{right}.cost")).alias("cost"), F.concat(F.col(f"{left}.script"), F.col(f"{right}.script")).alias("script"))
    return F.when(F.col(left).isNotNull() & F.col(right).isNotNull(), both)


def scripts(rows: DataFrame) -> DataFrame:
    """conv_id, cost, script: the cheapest edits of each conversation, the least of equally cheap ones."""
    spark = rows.sparkSession
    names = [f"x{p}{r}" for p, r in PAIRS]
    leaves = []
    for role in "suax":
        for fault in ("blank", "duplicate", "truncated", ""):
            cells = _leaf(role, fault)
            leaves.append((role, fault, *(cells.get(pair) for pair in PAIRS)))
    leaves = F.broadcast(spark.createDataFrame(leaves, "initial string, fault string, " + ", ".join(f"{n} {CELL}" for n in names)))  # 16 rows
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n")).toDF("c", "n")
    cells = rows.select("conv_id", "place", _initial(F.col("role")).alias("initial"), "fault").join(leaves, ["initial", "fault"])
    cells = cells.join(sizes, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "n", F.col("place").alias("span"), *names)
    cells = keep(cells, "cells-1")
    longest, width, done = cells.agg(F.max("n")).first()[0] or 0, 1, []
    while True:
        done.append(cells.where(F.col("n") <= width))
        if width >= longest:
            break
        cells = cells.where(F.col("n") > width)
        left = cells.where("span % 2 = 0").withColumn("half", F.shiftright("span", 1))
        right = cells.where("span % 2 = 1").select(F.col("conv_id").alias("c"), F.shiftright("span", 1).alias("h"), *(F.col(x).alias(f"r{x}") for x in names))
        met = left.join(right, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("half") == F.col("h")), "left")
        joined = []
        for p, r in PAIRS:
            ways = [_joined(f"x{p}{q}", f"rx{q}{r}") for q in range(4) if (p, q) in PAIRS and (q, r) in PAIRS]
            best = F.least(*ways) if len(ways) > 1 else ways[0]
            joined.append(F.when(F.col("h").isNull(), F.col(f"x{p}{r}")).otherwise(best).alias(f"x{p}{r}"))  # the last span may have no neighbour
        width *= 2
        cells = keep(met.select("conv_id", "n", F.col("half").alias("span"), *joined), f"cells-{width}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    end = lambda r: F.when(F.col(f"x0{r}").isNotNull(), F.struct((F.col(f"x0{r}.cost") + 2 * len(last)).alias("cost"), F.concat(F.col(f"x0{r}.script"), F.lit(last)).alias("script"))) if (last := INSERTED.get((r, 3), "")) or r in (0, 3) else None
    ends = [F.col("x00"), *(end(r) for r in (1, 2, 3))]
    return out.select("conv_id", F.least(*ends).alias("best")).select("conv_id", "best.cost", "best.script")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place, number, edit, role, text: the rows that are left, changed or new, in order of place and number."""
    parts = F.expr("regexp_extract_all(script, '[IJ]*[DKRS]|[IJ]+', 0)")
    edits = found.select(F.col("conv_id").alias("c"), F.posexplode(parts).alias("p", "letters"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p"))
    edits = edits.join(rows.select("conv_id", "place", "role", "text"), same, "left").select("c", "p", "role", "text", F.posexplode(F.split("letters", "")).alias("number", "edit"))
    edit, new = F.col("edit"), F.col("edit").isin("I", "J")
    role = F.when(edit.isin("I", "R"), "user").when(edit.isin("J", "S"), "assistant").otherwise(F.col("role"))
    return edits.where("edit IN ('I', 'J', 'K', 'R', 'S')").select(F.col("c").alias("conv_id"), F.col("p").alias("place"), "number", "edit", role.alias("role"), F.when(new, "").otherwise(F.col("text")).alias("text"))


def digests(fixed: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256. A digest needs a conversation in order: rows stream through one task, which keeps a hash."""

    def run(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
        now, state = None, None
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if now != (conv,):
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (conv,), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*now, state.hexdigest())))], schema)

    ordered_rows = fixed.repartition("conv_id").sortWithinPartitions("conv_id", "place", "number")
    return ordered_rows.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(chats: DataFrame) -> DataFrame:
    """Rows of chats (conv_id, turn, role, text) with the faults that the report is asked about, by CRC-32 of conv_id:turn."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def report(chats: DataFrame, rows: DataFrame) -> DataFrame:
    """What was found in the conversations of chats and how it is mended; rows are those to be judged."""
    rows = keep(with_faults(keep(ordered(rows), "placed")), "faults")
    found = keep(scripts(rows), "scripts")
    initial = F.substring("role", 1, 1)
    after = rows.select(F.col("conv_id").alias("c"), (F.col("place") - 1).alias("p"), initial.alias("next"))  # joined, for a window would hold a conversation
    pairs = rows.select("conv_id", "place", initial.alias("initial")).join(after, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p")))
    illegal = pairs.where(~F.concat("initial", "next").isin("su", "ua", "au")).groupBy("conv_id").agg(F.count("*").alias("illegal"))
    count = lambda fault: F.count(F.when(F.col("fault") == fault, 1)).alias(fault)
    gaps = F.coalesce(F.max("last") - F.min("first") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    turns = rows.groupBy("conv_id", "turn").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), *(count(f) for f in ("blank", "duplicate", "truncated")))
    facts = turns.groupBy("conv_id").agg(gaps, *(F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")))
    out = chats.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for i, side in enumerate((facts, illegal, found, digests(repaired(rows, found)))):
        out = out.join(side.withColumnRenamed("conv_id", f"c{i}"), F.col("conv_id").eqNullSafe(F.col(f"c{i}")), "left").drop(f"c{i}")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    audit = F.translate(F.coalesce("script", F.lit("")), "JS", "IR").alias("audit")
    return out.select("conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), audit, F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
