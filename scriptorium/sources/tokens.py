r"""Tokens of LaTeX sources, the partners of their braces and brackets, and the arguments of their commands.

A source is a row of tokens that tile it: a verbatim stretch or comment as a whole, a control word (with its star), an
escaped character, a brace, a bracket, white space within a line, a line's end, other text. What looks like a brace, a
command or a conditional inside a verbatim stretch or a comment is therefore no token, so that whatever is built on this
table leaves both alone. Partners come from windows over the tokens of a file: braces that open and close the same level
alternate, so that an opening brace's partner is the next of its level, to any depth. Nothing is read past a file.

Cases: a null source has no tokens; an opening brace that is never closed has no partner, and what follows it stands
inside; a closing brace too many is skipped. Files are told apart by path, which must be unique.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Environments whose text is taken as it stands.
VERBATIM = ["verbatim", "verbatim*", "Verbatim", "lstlisting", "minted", "comment", "filecontents", "spverbatim", "BVerbatim", "LVerbatim"]
#: A verbatim environment up to its own end, or a short stretch between two equal signs.
PROTECTED = r"(?s:\\begin\{(" + "|".join(v.replace("*", r"\*") for v in VERBATIM) + r")\}.*?\\end\{\1\})|\\verb\*?([^\sA-Za-z*])[^\n]*?\2"
TOKEN = PROTECTED + r"|%[^\n]*|\\[A-Za-z@]+\*?|(?s:\\.)|\\|[{}\[\]]|[ \t]+|\n|[^\\{}\[\]%\n \t]+"
#: Stands around protected stretches of a source while the rest is rewritten; sources must not hold it.
_MARK = "\ue001"


def outside_verbatim(source: Column, rewrite) -> Column:
    """source with rewrite (from Column to Column) applied to what lies between its protected stretches."""
    parts = F.split(F.regexp_replace(source, PROTECTED, _MARK + "$0" + _MARK), _MARK, -1)
    return F.array_join(F.transform(parts, lambda part, i: F.when(i % 2 == 1, part).otherwise(rewrite(part))), "")


#: Characters of sources whose tokens a task works on at a time, as about so many, or one longer source.
PART = 1 << 18
#: Characters of sources that a task only reads through.
READ = 1 << 23
#: Tokens in groups with a name that a task works on at a time, as about so many, or those of one source; and that a worker gives at once.
ROWS = 1 << 16


def spread(sources: DataFrame, path: str = "path", source: str = "source", part: int | None = None) -> DataFrame:
    """sources dealt by path over as many partitions as their size asks for, of about part (PART) characters: windows and groups by path and more then need no other shuffle, and what a task sorts doesn't grow with the input."""
    part = part or PART
    size = sources.agg(F.coalesce(F.sum(F.length(source) + 16), F.lit(0))).first()[0]
    return sources.repartition(max(sources.sparkSession.sparkContext.defaultParallelism, int(size) // part + 1), path)


def tokens(sources: DataFrame) -> DataFrame:
    """path, pos, token, kind, start, stop (characters from 0) of every token of sources (path, source)."""
    rows = spread(sources.select("path", "source")).select("path", F.posexplode(F.regexp_extract_all("source", F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    first, second = F.substring("token", 1, 1), F.substring("token", 2, 1)
    word = (first == "\\") & second.rlike("[A-Za-z@]")
    short = F.col("token").rlike(r"^\\verb\*?[^A-Za-z@*]")
    kind = F.when(short | (word & F.col("token").rlike(r"^\\begin\{")), "verbatim").when(first == "%", "comment").when(word, "word").when(first == "\\", "escape")
    kind = kind.when(F.col("token").isin("{", "}", "[", "]"), F.col("token")).when(F.col("token").rlike(r"^\s"), "space").otherwise("text")
    stop = F.sum(F.length("token")).over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("kind", kind).withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("token")).select("path", "pos", "token", "kind", "start", "stop")


def matched(rows: DataFrame, by: str, pos: str, opens: Column, closes: Column) -> DataFrame:
    """rows (start among their columns) with level, the number of openings before a row, itself included, less the closings
    before it, and partner and partner_start.

    An opening row's partner is the closing row of its level that comes next, and the other way round; null for rows that
    have none and for all others. Openings and closings of a level alternate, so that neighbours are partners.
    """
    change = F.when(opens, 1).when(closes, -1).otherwise(0)
    depth = F.sum(change).over(Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_change", change).withColumn("level", depth + (F.col("_change") == -1).cast("long"))
    of_level = Window.partitionBy(by, "level", F.col("_change") == 0).orderBy(pos)
    before, after = F.lag("_change").over(of_level), F.lead("_change").over(of_level)
    pair = lambda c: F.when((F.col("_change") == 1) & (after == -1), F.lead(c).over(of_level)).when((F.col("_change") == -1) & (before == 1), F.lag(c).over(of_level))
    return rows.withColumn("partner", pair(pos)).withColumn("partner_start", pair("start")).drop("_change")


def nested(rows: DataFrame) -> DataFrame:
    """tokens() with level and partner of braces, depth (the number of groups around a token) and group (the brace that opens the innermost)."""
    rows = matched(rows, "path", "pos", F.col("kind") == "{", F.col("kind") == "}")
    rows = rows.withColumn("depth", F.col("level") - F.col("kind").isin("{", "}").cast("long"))
    # an opening brace also counts in its own level, as the one that opens it
    own = F.struct(F.col("depth").alias("at"), F.lit(False).alias("opens"))
    role = F.when(F.col("kind") == "{", F.array(own, F.struct(F.col("level").alias("at"), F.lit(True).alias("opens")))).otherwise(F.array(own))
    rows = rows.withColumn("_role", F.explode(role))
    inside = Window.partitionBy("path", "_role.at").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    group = F.last(F.when(F.col("_role.opens"), F.col("pos")), ignorenulls=True).over(inside)
    return rows.withColumn("group", group).where("NOT _role.opens").drop("_role")


def groups(rows: DataFrame) -> DataFrame:
    """path, open, close (null if never closed), depth (0 at the top), parent of every group in braces; rows are nested() ones."""
    return rows.where("kind = '{'").select("path", F.col("pos").alias("open"), F.col("partner").alias("close"), "depth", F.col("group").alias("parent"))


_MARK_OR_WORD = re.compile(r"[^\\{}%]+|" + PROTECTED + r"|%[^\n]*|\\[A-Za-z@]+\*?|(?s:\\.)|[{}]", re.ASCII)
_TOKEN = re.compile(TOKEN, re.ASCII)


def _groups_with(source: str, names: set[str]) -> list[tuple]:
    """Opening brace (None at the top), depth, first character, end, and braces (closing None if never closed) of the groups inside, of every group in which a word of names stands."""
    found, inside = [], [(None, 0, 0, [])]
    named: set[int | None] = set()  # opening braces

    def end(at: int, close: int | None) -> None:
        group = inside.pop()
        if inside:
            inside[-1][3].append((group[0], close))
        if group[0] in named:
            found.append((*group[:3], at, group[3]))

    for m in _MARK_OR_WORD.finditer(source):
        at = m.start()
        if (c := source[at]) == "{":
            inside.append((at, inside[-1][1] + 1, at + 1, []))
        elif c == "}":
            depth = inside[0][1]
            end(at, at)
            if not inside:  # one too many
                named.discard(None)
                inside.append((None, depth - 1, at + 1, []))
        elif c == "\\" and m.lastindex is None and m.group()[1:].removesuffix("*") in names:
            named.add(inside[-1][0])
    while inside:
        end(len(source), None)
    return found


def _kind(m: re.Match) -> str:
    token = m.group()
    if m.group(1) or m.group(2) not in (None, "@"):
        return "verbatim"
    if token[0] == "%":
        return "comment"
    if token[0] == "\\":
        return "word" if re.match("[A-Za-z@]", token[1:]) else "escape"
    return token if token in "[]" else "space" if re.match(r"\s", token, re.ASCII) else "text"


def around(sources: DataFrame, names: list[str]) -> DataFrame:
    """Of nested() rows, what commands() reads of the groups in which a control word of names (without star) stands; pos is start.

    What stands in groups beside such a word, as bodies do, is passed over by the task that reads a source and is no row, so that
    the rows to sort grow with the definitions and what stands among them, not with what they hold.
    """
    types = {"path": sources.schema["path"].dataType.simpleString(), "pos": "int", "token": "string", "kind": "string", "start": "long", "stop": "long", "depth": "long", "group": "int", "partner": "int", "partner_start": "long"}
    names, arrow = set(names), [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches):
        for batch in batches:
            row, out = [], []

            def given():
                token, kind, start, depth, group, partner = (pa.array(x, t) for x, t in zip(zip(*out), arrow))
                stop = pa.array([r[2] + len(r[0]) for r in out], pa.int64())
                columns = [batch.column("path").take(pa.array(row)), start, token, kind, start.cast(pa.int64()), stop, depth, group, partner, partner.cast(pa.int64())]
                return pa.RecordBatch.from_arrays(columns, list(types))

            for n, source in enumerate(batch.column("source")):
                source = source.as_py() or ""
                for opening, depth, at, end, pairs in _groups_with(source, names):
                    for brace, close in [*pairs, (end, None)]:
                        for m in _TOKEN.finditer(source, at, brace):
                            if (kind := _kind(m)) not in ("space", "comment"):
                                out.append((m.group(), kind, m.start(), depth, opening, None))
                        if brace < end:
                            out.append(("{", "{", brace, depth, opening, close))
                            if close is None:
                                break
                            at = close + 1
                        row += [n] * (len(out) - len(row))
                        if len(out) >= ROWS:
                            yield given()
                            row, out = [], []
                    row += [n] * (len(out) - len(row))
            if out:
                yield given()

    return spread(sources.select("path", "source"), part=READ).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in types.items()))


def commands(rows: DataFrame) -> DataFrame:
    r"""path, pos, name, start, stop, before, then, then2, brace, args of every control word in nested() rows.

    args are the groups and options that follow at once, white space apart: at and close (positions; null if never closed),
    kind ({ or [), from and to (characters inside). An option begins only after a word, a group or an option, and ends at the next bracket of
    the same group. before is the token before, white space and comments apart, if it is a word without arguments; then
    and then2 are the two tokens after the arguments; brace is the next group within the same group, at any distance.
    """
    same = ["path", "depth", "group"]
    in_order = Window.partitionBy(*same).orderBy("pos")
    so_far, before = in_order.rowsBetween(Window.unboundedPreceding, 0), in_order.rowsBetween(Window.unboundedPreceding, -1)
    # the next of a kind is the last one from behind: a frame up to the end would be gone through again for each row
    behind = Window.partitionBy(*same).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("kind")
    rows = rows.where(~kind.isin("space", "comment", "}"))
    rows = rows.withColumn("_opt", (kind == "[") & F.lag("kind").over(in_order).isin("word", "{", "]"))
    rows = rows.withColumn("_last", F.last(F.when(F.col("_opt") | (kind == "]"), kind), ignorenulls=True).over(before))
    rows = rows.withColumn("_end", F.last(F.when(kind == "]", F.struct("pos", "start")), ignorenulls=True).over(behind))
    rows = rows.withColumn("_in", (F.col("_last") == "[") & (F.col("_end").isNotNull() | (kind == "]")))
    rows = rows.withColumn("_in", F.coalesce("_in", F.lit(False)))
    shut = F.when(kind == "{", F.struct(F.col("partner").alias("pos"), F.col("partner_start").alias("start"))).otherwise(F.col("_end"))
    arg = F.struct(F.col("pos").alias("at"), "kind", shut["pos"].alias("close"), F.col("stop").alias("from"), shut["start"].alias("to"))
    rows = rows.withColumn("brace", F.last(F.when(kind == "{", arg), ignorenulls=True).over(behind))
    rows = rows.withColumn("_arg", ~F.col("_in") & ((kind == "{") | (F.col("_opt") & F.col("_end").isNotNull())))
    rows = rows.where(~F.col("_in")).withColumn("_run", F.sum((~F.col("_arg")).cast("long")).over(so_far))
    runs = rows.groupBy(*same, "_run").agg(
        F.min(F.when(~F.col("_arg"), F.struct("pos", "token", "kind", "start", "stop", "brace"))).alias("h"),
        F.sort_array(F.collect_list(F.when(F.col("_arg"), arg))).alias("args"),
    )
    runs = runs.where("h IS NOT NULL")
    in_runs = Window.partitionBy(*same).orderBy("_run")
    lone = F.when((F.lag("h.kind").over(in_runs) == "word") & (F.size(F.lag("args").over(in_runs)) == 0), F.lag("h.token").over(in_runs))
    runs = runs.withColumn("before", lone).withColumn("then", F.lead("h.token").over(in_runs)).withColumn("then2", F.lead("h.token", 2).over(in_runs))
    return runs.where("h.kind = 'word'").select("path", "h.pos", F.substring("h.token", 2, 1 << 30).alias("name"), "h.start", "h.stop", "before", "then", "then2", "h.brace", "args")


def texts_between(sources: DataFrame, rows: DataFrame, **spans: tuple[str, str]) -> DataFrame:
    """rows (path and more) with a column for each span: the source's characters from the first column's value to before the second's; null where either is."""
    keep = [c for c in rows.columns if c != "path"]
    each = rows.groupBy("path").agg(F.collect_list(F.struct(*keep)).alias("_rows"))
    cut = lambda r, a, b: F.when(r[a].isNotNull() & r[b].isNotNull(), F.substring("source", r[a] + 1, r[b] - r[a]))
    fill = F.transform("_rows", lambda r: F.struct(*(r[c].alias(c) for c in keep), *(cut(r, a, b).alias(name) for name, (a, b) in spans.items())))
    return sources.select("path", "source").join(each, "path").select("path", F.explode(fill).alias("_r")).select("path", "_r.*")
