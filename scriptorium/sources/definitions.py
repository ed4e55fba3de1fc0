"""Definitions in LaTeX sources as rows: macros, theorem kinds, glossaries, colours and bibliography items.

Every function takes sources (path, source) and gives one row for each definition, with pos, its place among those of
its kind in the file. They start from the table of commands and their arguments, so that braces nest to any depth and
verbatim stretches and comments define nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.structure import written
from scriptorium.sources import tokens

#: White space that may stand between arguments.
_GAP = r"\s*+"
#: Commands that define a command or an environment, by the arguments that they take.
COMMANDS = ["newcommand", "renewcommand", "providecommand", "DeclareRobustCommand"]
DOCUMENT_COMMANDS = ["NewDocumentCommand", "RenewDocumentCommand", "ProvideDocumentCommand", "DeclareDocumentCommand"]
PARAMETERS = ["def", "gdef", "edef", "xdef"]
ENVIRONMENTS = ["newenvironment", "renewenvironment"]
DOCUMENT_ENVIRONMENTS = ["NewDocumentEnvironment", "RenewDocumentEnvironment", "ProvideDocumentEnvironment", "DeclareDocumentEnvironment"]


def found_commands(sources: DataFrame, names: list[str]) -> DataFrame:
    """The commands in groups in which one of names stands, with their arguments, as tokens.commands() gives them with pos = start; the readers below start from these rows.

    Their tokens are written, then dealt by count.
    """
    rows = written(tokens.around(sources, names))
    return tokens.commands(rows.repartition(max(sources.sparkSession.sparkContext.defaultParallelism, rows.count() // tokens.ROWS + 1), "path"))


def _plain(c: Column) -> Column:
    """A command's name without backslash and star."""
    return F.regexp_replace(c, r"^\\|\*$", "")


def _groups(args: Column) -> Column:
    return F.filter(args, lambda a: a["kind"] == "{")


def _options(args: Column) -> Column:
    """The options before the first group."""
    first = F.array_position(F.transform(args, lambda a: a["kind"]), "{")
    return F.slice(args, F.lit(1), F.when(first > 0, first - 1).otherwise(F.size(args)).cast("int"))


def _read(sources: DataFrame, rows: DataFrame, **args: Column) -> DataFrame:
    """rows with the text of each argument, null where it is missing or never closed; pos counts the rows of a file from 0."""
    ends = [c for n, arg in args.items() for c in (arg["from"].alias(f"{n}_from"), arg["to"].alias(f"{n}_to"))]
    rows = rows.select(*(c for c in rows.columns if c not in ("args", "brace")), *ends)
    rows = tokens.texts_between(sources, rows, **{n: (f"{n}_from", f"{n}_to") for n in args}).drop(*(f"{n}_{end}" for n in args for end in ("from", "to")))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("path").orderBy("pos")) - 1)


def _outermost(rows: DataFrame) -> DataFrame:
    """rows without those that stand before the end of an earlier one: what a definition holds is not defined yet."""
    earlier = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_until", F.max("ends").over(earlier)).where("_until IS NULL OR _until < pos").drop("_until", "ends")


def _spelled(c: Column) -> Column:
    """Text with the name of a command, without what stands around it."""
    return F.regexp_extract(c, r"^\s*\\([A-Za-z@]+)\s*$", 1)


def macro_definitions(sources: DataFrame) -> DataFrame:
    r"""path, pos, command, name, arity, default (null without one), parameters (null but for \\def and the like), spec (null but for document commands), body.

    The name may stand in braces or not. Braces nest to any depth; a body may also be the one command that follows, as it
    always is for \\let. What has no body, or one whose brace never closes, is no definition, and neither is
    what another definition holds.
    """
    found = found_commands(sources, [*COMMANDS, *DOCUMENT_COMMANDS, *PARAMETERS, "let"])
    of_name, of_word = _plain(F.col("name")).isin([*COMMANDS, *DOCUMENT_COMMANDS]), _plain(F.col("before")).isin([*COMMANDS, *DOCUMENT_COMMANDS, *PARAMETERS, "let"])
    found = written(found.where(of_name | of_word))
    args, none = F.col("args"), F.lit(None).cast(found.schema["brace"].dataType)
    span = lambda a, b: F.struct(F.lit(0).alias("at"), F.lit("").alias("kind"), F.lit(0).alias("close"), a.alias("from"), b.alias("to"))
    kinds = [*COMMANDS, *DOCUMENT_COMMANDS]
    braced = found.where(_plain(F.col("name")).isin(kinds) & (F.get("args.kind", 0) == "{"))
    braced = braced.select("path", "pos", _plain(F.col("name")).alias("command"), F.get(args, 0).alias("name_arg"), F.slice("args", 2, 1 << 20).alias("args"), "then", "then2", "stop", "brace")
    plain = found.where(_plain(F.col("before")).isin([*kinds, *PARAMETERS, "let"]))
    plain = plain.select("path", "pos", _plain(F.col("before")).alias("command"), span(F.col("start"), F.col("stop")).alias("name_arg"), "args", "then", "then2", "stop", "brace")
    rows = braced.unionByName(plain).withColumn("bodies", F.size(_groups(args)))
    command, groups = F.col("command"), _groups(args)
    document, given = command.isin(DOCUMENT_COMMANDS), command.isin(PARAMETERS)
    body = F.when(given, F.col("brace")).when(document, F.get(groups, 1)).when(command != "let", F.get(groups, 0)).otherwise(none)
    number, default = F.get(_options(args), 0), F.get(_options(args), 1)
    rows = _outermost(rows.withColumn("ends", body["close"]))
    parameters = F.when(given, span(F.col("stop"), F.col("brace.from") - 1))
    out = _read(sources, rows, name=F.col("name_arg"), number=F.when(command.isin(COMMANDS), number), default=F.when(command.isin(COMMANDS), default), parameters=parameters, spec=F.when(document, F.get(groups, 0)), body=body)
    follows = F.when(command == "let", F.when(F.col("then") == "=", F.col("then2")).otherwise(F.regexp_replace("then", "^=", "")))
    follows = F.when(F.col("bodies") == 0, F.coalesce(follows, F.when(command.isin(COMMANDS) & F.col("then").rlike(r"^\\"), F.col("then"))))
    arity = F.when(given, F.regexp_count("parameters", F.lit(r"#\d"))).when(document, F.size(arguments_of(F.col("spec")))).otherwise(F.coalesce(F.col("number").try_cast("int"), F.lit(0)))
    return out.select("path", "pos", "command", _spelled(F.regexp_replace("name", r"\*$", "")).alias("name"), arity.alias("arity"), "default", "parameters", "spec", F.coalesce("body", follows).alias("body")).where("body IS NOT NULL AND name <> ''")


def arguments_of(spec: Column) -> Column:
    """The kinds of argument that a document command's specification lists, defaults and processors left out: s, m, o or O, r or R, d or D."""
    bare = spec
    return F.regexp_extract_all(F.regexp_replace(bare, r">\s*\{[^{}]*\}|\{(?:[^{}]|\{[^{}]*\})*\}|[+! ]", ""), F.lit(r"[smoO]|[rRdD]\S\S"), F.lit(0))


def environment_definitions(sources: DataFrame) -> DataFrame:
    """path, pos, command, name, arity, default (null without one), spec (null but for document environments), begin, end of every environment that is defined."""
    rows = found_commands(sources, [*ENVIRONMENTS, *DOCUMENT_ENVIRONMENTS]).withColumn("command", _plain(F.col("name"))).where(F.col("command").isin([*ENVIRONMENTS, *DOCUMENT_ENVIRONMENTS]))
    document, groups, rest = F.col("command").isin(DOCUMENT_ENVIRONMENTS), _groups(F.col("args")), F.slice("args", 2, 1 << 20)
    code = lambda i: F.when(document, F.get(groups, i + 1)).otherwise(F.get(groups, i))
    option = lambda i: F.when(~document, F.get(_options(rest), i))
    rows = _outermost(rows.withColumn("ends", code(2)["close"]))
    out = _read(sources, rows.select("path", "pos", "command", "args"), name=F.get(groups, 0), number=option(0), default=option(1), spec=F.when(document, F.get(groups, 1)), begin=code(1), end=code(2))
    arity = F.when(F.col("spec").isNotNull(), F.size(arguments_of(F.col("spec")))).otherwise(F.coalesce(F.col("number").try_cast("int"), F.lit(0)))
    return out.select("path", "pos", "command", F.trim("name").alias("name"), arity.alias("arity"), "default", "spec", "begin", "end").where("begin IS NOT NULL AND end IS NOT NULL AND name <> ''")


def macros(definitions: DataFrame) -> DataFrame:
    """path, name, arity, default, body that hold at the end of a file.

    The last definition of a name counts, but one that only provides a name never replaces another; of several of those
    the first counts.
    """
    provided = F.col("command") == "providecommand"
    rank = F.when(provided, -F.col("pos") - 1).otherwise(F.col("pos"))
    last = definitions.groupBy("path", "name").agg(F.max_by(F.struct("arity", "default", "body"), rank).alias("d"))
    return last.select("path", "name", "d.*")


def safe_macros(macros: DataFrame, protected: list[str]) -> DataFrame:
    """Macros without internal names (an at sign in name or body), protected names or a body that calls the macro itself."""
    itself = F.regexp_count("body", F.concat(F.lit("\\\\"), F.col("name"), F.lit("(?![A-Za-z])"))) > 0
    inside = F.contains("name", F.lit("@")) | F.contains("body", F.lit("@"))
    return macros.where(~inside & ~F.col("name").isin(protected) & ~itself)


def theorem_kinds(sources: DataFrame) -> DataFrame:
    """path, pos, name, numbered, shared (the kind whose counter it uses), title, within; empty where not given."""
    rows = found_commands(sources, ["newtheorem"]).where(_plain(F.col("name")) == "newtheorem").select("path", "pos", F.col("name").alias("command"), "args")
    after = F.slice("args", 2, 1 << 20)
    titled = F.array_position(F.transform(after, lambda a: a["kind"]), "{").cast("int")
    within = F.get(F.filter(F.slice(after, titled + 1, F.lit(1)), lambda a: a["kind"] == "["), 0)
    out = _read(sources, rows.where("args[1] IS NOT NULL AND exists(slice(args, 2, 3), a -> a.kind = '{')"), name=F.get(_groups(F.col("args")), 0), shared=F.get(_options(after), 0), title=F.get(_groups(after), 0), within=within)
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("path", "pos", "name", (~F.endswith("command", F.lit("*"))).alias("numbered"), empty("shared"), "title", empty("within")).where("title IS NOT NULL")


def _with_groups(sources: DataFrame, command: str, *names: str) -> DataFrame:
    """path, pos and the text of the first groups of every such command that has them all."""
    rows = found_commands(sources, [command]).where(F.col("name") == command).select("path", "pos", "args")
    out = _read(sources, rows, **{n: F.get(_groups(F.col("args")), i) for i, n in enumerate(names)})
    return out.where(" AND ".join(f"{n} IS NOT NULL" for n in names))


def acronyms(sources: DataFrame) -> DataFrame:
    """path, pos, key, short, long."""
    return _with_groups(sources, "newacronym", "key", "short", "long")


def colours(sources: DataFrame) -> DataFrame:
    """path, pos, name, model, spec; of several definitions of a name in a file all are rows, in order."""
    return _with_groups(sources, "definecolor", "name", "model", "spec")


def bibliography_items(sources: DataFrame) -> DataFrame:
    """path, number (from 1), key, label (null without one), text of every item of a bibliography list, up to the list's end."""
    rows = found_commands(sources, ["bibitem", "end"]).where("name = 'bibitem' OR (name = 'end' AND args[0].kind = '{')")
    ends = F.min(F.when(F.col("name") == "end", F.col("start"))).over(Window.partitionBy("path").orderBy("pos").rowsBetween(1, Window.unboundedFollowing))
    following = F.min(F.when(F.col("name") == "bibitem", F.col("start"))).over(Window.partitionBy("path").orderBy("pos").rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("next", F.coalesce(F.least(ends, following), F.lit(1 << 40))).where("name = 'bibitem'")
    item = F.struct(F.lit(0).alias("at"), F.lit("").alias("kind"), F.lit(0).alias("close"), (F.get(_groups(F.col("args")), 0)["to"] + 1).alias("from"), F.col("next").alias("to"))
    out = _read(sources, rows.select("path", "pos", "args", "next"), key=F.get(_groups(F.col("args")), 0), label=F.get(_options(F.col("args")), 0), text=item).where("key <> ''")
    return out.select("path", (F.col("pos") + 1).alias("number"), "key", "label", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


def sole_lists(files: DataFrame) -> DataFrame:
    """Of files (path, dir and more), those that are the only one of their folder."""
    alone = F.count("*").over(Window.partitionBy("dir"))
    return files.withColumn("_n", alone).where("_n = 1").drop("_n")


def preferred_items(items: DataFrame) -> DataFrame:
    """Of items (path, key, priority and more), the one of the highest priority of each key of a file; priorities of a key differ."""
    w = Window.partitionBy("path", "key").orderBy(F.desc("priority"))
    return items.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "priority")


# rewrites of whole sources


def starred_outside(source: Column) -> Column:
    """A star after an environment's braces put inside them."""
    return F.regexp_replace(source, r"\\(begin|end)\*\{([A-Za-z]+)\}", r"\\$1{$2*}")


def operators_as_commands(source: Column) -> Column:
    """Declared operators of mathematics as commands for their upright names, whose braces nest twice at most."""
    pattern = r"\\DeclareMathOperator(\*?)" + _GAP + r"\{?\s*+(\\[A-Za-z]++)\s*+\}?" + _GAP + r"\{((?:[^{}]++|\{(?:[^{}]++|\{[^{}]*+\})*+\})*+)\}"
    return tokens.outside_verbatim(source, lambda part: F.regexp_replace(part, pattern, r"\\newcommand{$2}{\\operatorname$1{$3}}"))


def listings_as_verbatim(source: Column) -> Column:
    """Listing environments as verbatim ones, without their options."""
    begun = F.regexp_replace(source, r"\\begin\{(?:lstlisting|Verbatim)\}(?:\[[^\]]*\])?|\\begin\{minted\}(?:\[[^\]]*\])?\{[^{}]*\}", r"\\begin{verbatim}")
    return F.regexp_replace(begun, r"\\end\{(?:lstlisting|Verbatim|minted)\}", r"\\end{verbatim}")


def without_glue(source: Column) -> Column:
    """Without skips of a given length, with what they may stretch or shrink by."""
    length = r"-?(?:\d+(?:\.\d*)?|\.\d+)\s*(?:pt|em|ex|cm|mm|in|bp|pc|fil+)"
    return tokens.outside_verbatim(source, lambda part: F.regexp_replace(part, rf"\\[vh]skip\s*{length}(?:\s*plus\s*{length})?(?:\s*minus\s*{length})?", ""))
