r"""Conditionals of LaTeX sources whose outcome is known without running TeX.

Conditionals are intervals of the token table: \if...\else...\fi by levels, as braces are, and commands with a test and
two branches by their arguments. A test is true, false or unknown (null); unknown ones stay as they are, and what they
hold is resolved. A switch has the value of its latest assignment before the test that is not in a dropped branch, an
as-of join over the assignments of the file; a command is defined if such a definition comes before.

Which assignments are dropped depends on earlier tests, so values are worked out in rounds until none changes: a value
depends on earlier ones only, so that the rounds end, and end in the only consistent values. A round is a few windows
over the conditionals and assignments of all files, never over their texts.

Known tests: \iftrue, \iffalse, switches of \newif, \ifdefined, \ifcsname; \ifthenelse with \boolean, \equal and
\isundefined, also after \not; \iftoggle, \nottoggle, \ifbool, \notbool, \ifdef, \ifundef, \@ifundefined, and whether a
package or class is loaded. Whether a file exists is unknown here. Declarations and assignments go. Verbatim stretches
and comments are left alone. A kept letter never joins the control word before it: a space comes between.

A branch in braces holds whole conditionals; one that a conditional crosses is cut where its interval ends.

Cases: a null source stays null, an empty one empty; a conditional that never ends stays; \fi and \else too many stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.structure import written
from scriptorium.sources import tokens
from scriptorium.sources.definitions import COMMANDS, DOCUMENT_COMMANDS, PARAMETERS

#: Conditionals that \fi ends, besides switches.
PRIMITIVE = (
    "if ifcat ifnum ifdim ifodd ifvmode ifhmode ifmmode ifinner ifvoid ifhbox ifvbox ifx ifeof iftrue iffalse ifcase ifdefined ifcsname iffontchar "
    "ifincsname ifpdfprimitive ifpdf ifxetex ifluatex ifPDFTeX ifXeTeX ifLuaTeX ifptex ifuptex"
).split()
#: Commands that every document has.
KERNEL = (
    "section subsection subsubsection paragraph subparagraph textbf textit emph texttt label ref cite caption footnote item begin end newcommand renewcommand "
    "def let relax par today LaTeX TeX maketitle title author date includegraphics url href textcolor color frac sqrt mathbb mathbf mathrm"
).split()
#: Classes that have chapters.
CHAPTERS = ["book", "report", "memoir", "scrbook", "scrreprt", "amsbook"]
#: What a command with a test and two branches asks, and whether it asks for the contrary.
BRANCHES = {
    "ifthenelse": ("formula", False), "iftoggle": ("toggle", False), "nottoggle": ("toggle", True), "ifbool": ("boolean", False), "notbool": ("boolean", True),
    "ifdef": ("defined", False), "ifundef": ("defined", True), "ifdefmacro": ("defined", False), "ifcsdef": ("defined", False), "ifcsundef": ("defined", True), "@ifundefined": ("defined", True),
    "@ifpackageloaded": ("package", False), "IfPackageLoadedTF": ("package", False), "@ifclassloaded": ("class", False), "IfClassLoadedTF": ("class", False),
}
#: What a command does to a variable: its kind, and the value, null where the second argument says it; or whether it only provides one.
ASSIGNED = {
    "newboolean": ("boolean", False, False), "newbool": ("boolean", False, False), "newtoggle": ("toggle", False, False),
    "provideboolean": ("boolean", False, True), "providebool": ("boolean", False, True), "providetoggle": ("toggle", False, True),
    "setboolean": ("boolean", None, False), "setbool": ("boolean", None, False), "settoggle": ("toggle", None, False),
    "booltrue": ("boolean", True, False), "boolfalse": ("boolean", False, False), "toggletrue": ("toggle", True, False), "togglefalse": ("toggle", False, False),
}


def _table(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def _switches(words: DataFrame) -> DataFrame:
    r"""path, switch, at: names that a file declares with \newif, and where the declaration's second word stands."""
    rows = words.where("last = 'newif' AND name LIKE 'if%'")
    return rows.select("path", F.substring("name", 3, 1 << 20).alias("switch"), "last_at", F.col("pos").alias("at"))


def _primitive(words: DataFrame, names: DataFrame) -> DataFrame:
    r"""Conditionals that \fi ends: path, at, test, key, inverse, and the positions of the branches and of the end."""
    switches = names.select("path", F.concat(F.lit("if"), "switch").alias("name")).distinct().withColumn("is_switch", F.lit(True))
    rows = words.join(switches, ["path", "name"], "left")
    own = F.col("is_switch") | F.col("name").isin(PRIMITIVE)
    opens = F.coalesce(own & ~F.coalesce(F.col("last") == "newif", F.lit(False)), F.lit(False))
    rows = rows.withColumn("opens", opens).where(F.col("opens") | F.col("name").isin("else", "fi"))
    rows = tokens.matched(rows, "path", "pos", F.col("opens"), F.col("name") == "fi")
    before = Window.partitionBy("path", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("name") != "else", F.when(F.col("opens"), F.col("pos")).otherwise(-1)), ignorenulls=True).over(before)
    rows = rows.withColumn("owner", F.when(F.col("name") == "else", owner))
    other = rows.where("owner >= 0").groupBy("path", F.col("owner").alias("pos")).agg(F.min("pos").alias("other"))
    rows = rows.where("opens AND partner IS NOT NULL").join(other.withColumnRenamed("other", "middle"), ["path", "pos"], "left")
    name = F.col("name")
    test = F.when(F.col("is_switch"), "switch").when(name.isin("iftrue", "iffalse"), "known").when((name == "ifdefined") & F.col("next").rlike(r"^\\[A-Za-z@]"), "defined")
    test = test.when((name == "ifcsname") & F.col("next").rlike("^[A-Za-z@]+$") & (F.col("next2") == r"\endcsname"), "defined")
    key = F.when(F.col("is_switch"), F.substring("name", 3, 1 << 20)).when(name.isin("iftrue", "iffalse"), F.substring("name", 3, 9)).otherwise(F.regexp_replace("next", r"^\\|\*$", ""))
    rows = rows.withColumn("test", test)
    head = F.when(F.col("test").isNull() | (F.col("test") != "defined"), F.col("pos") + 1).when(name == "ifdefined", F.col("next_at") + 1).otherwise(F.col("next2_at") + 1)
    fi = F.col("partner")
    return rows.select("path", F.col("pos").alias("at"), "test", key.alias("key"), F.lit(False).alias("inverse"), head.alias("yes_from"), F.coalesce("middle", fi).alias("yes_to"), F.coalesce(F.col("middle") + 1, fi).alias("no_from"), fi.alias("no_to"), (fi + 1).alias("stop"))


def _branching(sources: DataFrame, found: DataFrame) -> DataFrame:
    """Commands with a test and two branches, in the same form."""
    rows = found.where(F.col("name").isin(list(BRANCHES))).withColumn("g", F.filter("args", lambda a: a["kind"] == "{"))
    rows = rows.where("size(g) >= 3 AND g[0].close IS NOT NULL AND g[1].close IS NOT NULL AND g[2].close IS NOT NULL")
    rows = rows.select("path", "pos", "name", "g", F.get("g.from", 0).alias("a"), F.get("g.to", 0).alias("b"))
    rows = tokens.texts_between(sources, rows, asked=("a", "b"))
    asked = F.trim("asked")
    test, inverse = _table({k: v[0] for k, v in BRANCHES.items()}, F.col("name")), _table({k: v[1] for k, v in BRANCHES.items()}, F.col("name"))
    bare = F.regexp_replace(asked, r"^(?:\\not\s*)+", "")
    nots = F.regexp_count(F.regexp_extract(asked, r"^((?:\\not\s*)*)", 1), F.lit(r"\\not")) % 2 == 1
    boolean, equal, undefined = r"^\\boolean\s*\{([^{}]*)\}$", r"^\\equal\s*\{([^{}]*)\}\s*\{([^{}]*)\}$", r"^\\isundefined\s*\{?\s*\\([A-Za-z@]+)\s*\}?$"
    formula = F.col("test") == "formula"
    rows = rows.select("path", "pos", "g", test.alias("test"), inverse.alias("inverse"), asked.alias("asked"), bare.alias("bare"), nots.alias("nots"))
    same = F.trim(F.regexp_extract("bare", equal, 1)) == F.trim(F.regexp_extract("bare", equal, 2))
    key = F.when(formula & F.col("bare").rlike(boolean), F.trim(F.regexp_extract("bare", boolean, 1))).when(formula & F.col("bare").rlike(equal), same.cast("string"))
    key = key.when(formula & F.col("bare").rlike(undefined), F.regexp_extract("bare", undefined, 1)).when(formula, None).otherwise(F.regexp_replace("asked", r"^\\", ""))
    kind = F.when(~formula, F.col("test")).when(F.col("bare").rlike(boolean), "boolean").when(F.col("bare").rlike(equal), "known").when(F.col("bare").rlike(undefined), "defined")
    contrary = F.when(formula, F.when(F.col("bare").rlike(undefined), ~F.col("nots")).otherwise(F.col("nots"))).otherwise(F.col("inverse"))
    at, close = lambda i: F.get("g.at", i) + 1, lambda i: F.get("g.close", i)
    return rows.select("path", F.col("pos").alias("at"), kind.alias("test"), key.alias("key"), contrary.alias("inverse"), at(1).alias("yes_from"), close(1).alias("yes_to"), at(2).alias("no_from"), close(2).alias("no_to"), (close(2) + 1).alias("stop"))


def _facts(sources: DataFrame, words: DataFrame, found: DataFrame, names: DataFrame) -> DataFrame:
    """path, at, test, key, value, provided, to: assignments and definitions, with the position up to which they go; to is null where they stay."""
    skip = F.col("pos") + 1 + F.coalesce(F.col("gap").cast("int"), F.lit(0))
    ends = [words.withColumn("key", F.regexp_extract("name", f"^(.+){value}$", 1)).withColumn("value", F.lit(value == "true")) for value in ("true", "false")]
    set_ = ends[0].unionByName(ends[1]).where("key <> ''").join(names.select("path", F.col("switch").alias("key")).distinct(), ["path", "key"], "left_semi")
    out = set_.select("path", F.col("pos").alias("at"), F.lit("switch").alias("test"), "key", "value", F.lit(False).alias("provided"), skip.alias("to"))

    rows = found.where(F.col("name").isin(list(ASSIGNED))).withColumn("g", F.filter("args", lambda a: a["kind"] == "{"))
    rows = rows.withColumn("needs", F.when(F.col("name").like("set%"), 2).otherwise(1)).where("size(g) >= needs AND g[0].close IS NOT NULL AND element_at(g, needs).close IS NOT NULL")
    one = lambda f, i: F.get(f"g.{f}", i)
    rows = rows.select("path", "pos", "name", "needs", F.element_at("g", F.col("needs"))["close"].alias("close"), one("from", 0).alias("a"), one("to", 0).alias("b"), F.when(F.col("needs") == 2, one("from", 1)).alias("c"), F.when(F.col("needs") == 2, one("to", 1)).alias("d"))
    rows = tokens.texts_between(sources, rows, key=("a", "b"), said=("c", "d"))
    part = lambda i: _table({k: v[i] for k, v in ASSIGNED.items() if v[i] is not None}, F.col("name"))
    value = F.coalesce(part(1), F.lower(F.trim("said")) == "true")
    out = out.unionByName(rows.select("path", F.col("pos").alias("at"), part(0).alias("test"), F.trim("key").alias("key"), value.alias("value"), part(2).alias("provided"), (F.col("close") + 1).alias("to")))

    defines = [*COMMANDS, *DOCUMENT_COMMANDS, *PARAMETERS, "let", "newlength", "newsavebox", "newif", "DeclareMathOperator"]
    named = words.where(F.col("last").isin(defines)).select("path", F.col("last_at").alias("at"), F.col("name").alias("key"))
    braced = found.where(F.regexp_replace("name", r"\*$", "").isin(defines)).select("path", "pos", F.get("args.from", 0).alias("a"), F.get("args.to", 0).alias("b"))
    braced = tokens.texts_between(sources, braced, key=("a", "b")).select("path", F.col("pos").alias("at"), F.regexp_extract("key", r"^\s*\\([A-Za-z@]+)\s*$", 1).alias("key")).where("key <> ''")
    defined = named.unionByName(braced).select("path", "at", F.lit("defined").alias("test"), "key", F.lit(True).alias("value"), F.lit(False).alias("provided"), F.lit(None).cast("int").alias("to"))
    declared = names.select("path", F.col("last_at").alias("at"), F.lit("none").alias("test"), F.lit("").alias("key"), F.lit(True).alias("value"), F.lit(False).alias("provided"), (F.col("at") + 1).alias("to"))
    return out.unionByName(defined).unionByName(declared)


def _loaded(sources: DataFrame, found: DataFrame) -> DataFrame:
    """path, test (package or class), key of everything that a file loads, wherever it does."""
    plain = F.col("name")
    rows = found.where(plain.isin("usepackage", "RequirePackage", "documentclass", "LoadClass")).withColumn("g", F.filter("args", lambda a: a["kind"] == "{"))
    rows = rows.select("path", F.when(plain.isin("documentclass", "LoadClass"), "class").otherwise("package").alias("test"), F.get("g.from", 0).alias("a"), F.get("g.to", 0).alias("b"))
    return tokens.texts_between(sources, rows, names=("a", "b")).select("path", "test", F.explode(F.split("names", r"\s*,\s*")).alias("key")).select("path", "test", F.trim("key").alias("key")).distinct()


def tests(sources: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conditionals of nested() tokens with value (true, false or null), and the assignments."""
    solid = Window.partitionBy("path").orderBy("pos")
    gap = (F.lead("kind").over(solid) == "space") & (F.lead("token").over(solid) != "\n")
    words = rows.withColumn("gap", gap).where("kind NOT IN ('space', 'comment')")
    lead = lambda c, n: F.lead(c, n).over(solid)
    name = lambda c: F.regexp_replace(c, r"^\\|\*$", "")
    words = words.withColumns({"next": lead("token", 1), "next_at": lead("pos", 1), "next2": lead("token", 2), "next2_at": lead("pos", 2), "last": F.when(F.lag("kind").over(solid) == "word", name(F.lag("token").over(solid))), "last_at": F.lag("pos").over(solid)})
    words = written(words.where("kind = 'word'").withColumn("name", name("token")))
    found = written(tokens.commands(rows))
    names = written(_switches(words))
    conds = _primitive(words, names).unionByName(_branching(sources, found))
    loaded = _loaded(sources, found)
    conds = conds.join(loaded.withColumn("is_loaded", F.lit(True)), ["path", "test", "key"], "left")
    book = loaded.where(F.col("test") == "class").where(F.col("key").isin(CHAPTERS)).select("path").distinct().withColumn("chapters", F.lit(True))
    conds = conds.join(book, "path", "left")
    switch = names.select("path", F.explode(F.array("switch", F.concat(F.lit("if"), "switch"))).alias("key")).distinct()
    conds = conds.join(switch.withColumn("is_switch", F.lit(True)), ["path", "key"], "left")
    always = F.col("key").isin(KERNEL) | F.coalesce("is_switch", F.lit(False)) | ((F.col("key") == "chapter") & F.coalesce("chapters", F.lit(False)))
    fixed = F.when(F.col("test") == "known", F.col("key") == "true").when(F.col("test").isin("package", "class"), F.coalesce("is_loaded", F.lit(False))).when((F.col("test") == "defined") & always, True)
    conds = written(conds.withColumn("fixed", fixed).drop("is_loaded", "chapters", "is_switch"))
    facts = written(_facts(sources, words, found, names))
    return _valued(conds, facts), facts


def _valued(conds: DataFrame, facts: DataFrame) -> DataFrame:
    now = conds.withColumn("value", F.when(F.col("fixed").isNotNull(), F.col("fixed") != F.col("inverse")))
    while True:
        # what lies in a branch that is not taken, by a running count of the branches that are open
        no = F.when(F.col("value"), F.struct(F.col("no_from").alias("a"), F.col("no_to").alias("b"))).otherwise(F.struct(F.col("yes_from").alias("a"), F.col("yes_to").alias("b")))
        dropped = now.where("value IS NOT NULL").select("path", no.alias("d"))
        edges = dropped.select("path", F.explode(F.array(F.struct(F.col("d.a").alias("at"), F.lit(1).alias("change")), F.struct(F.col("d.b").alias("at"), F.lit(-1).alias("change")))).alias("e")).select("path", "e.at", "e.change")
        edges = edges.groupBy("path", "at").agg(F.sum("change").alias("change"))
        marked = facts.withColumn("change", F.lit(0)).unionByName(edges, allowMissingColumns=True)
        open_ = F.sum("change").over(Window.partitionBy("path").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
        live = marked.withColumn("open", open_).where("test IS NOT NULL AND open = 0")
        said = live.select("path", "test", "key", "at", "value", "provided").unionByName(now.select("path", "test", "key", "at", F.lit(None).cast("boolean").alias("value"), F.lit(None).cast("boolean").alias("provided")))
        before = Window.partitionBy("path", "test", "key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        last = F.last(F.when(~F.col("provided"), F.col("value")), ignorenulls=True).over(before)
        any_ = F.max(F.when(F.col("provided"), 1)).over(before) == 1
        value = F.coalesce(last, F.when(any_, False), F.when(F.col("test").isin("switch", "defined"), False))
        latest = said.withColumn("latest", value).where("provided IS NULL AND test IN ('switch', 'boolean', 'toggle', 'defined')").select("path", "at", "latest")
        new = now.join(latest, ["path", "at"], "left")
        new = new.withColumn("was", F.col("value")).withColumn("value", F.coalesce("fixed", "latest") != F.col("inverse")).drop("latest")
        new = written(new)
        if new.where(~F.col("was").eqNullSafe(F.col("value"))).isEmpty():
            return new.drop("was")
        now = new.drop("was")


def resolved(sources: DataFrame) -> DataFrame:
    """sources (path, source) with the conditionals that can be told replaced by the branch that TeX would take."""
    rows = written(tokens.nested(tokens.tokens(sources)))
    conds, facts = tests(sources, rows)
    cuts = F.when(F.col("value"), F.array(F.struct(F.col("at").alias("a"), F.col("yes_from").alias("b")), F.struct(F.col("yes_to").alias("a"), F.col("stop").alias("b"))))
    cuts = cuts.otherwise(F.array(F.struct(F.col("at").alias("a"), F.col("no_from").alias("b")), F.struct(F.col("no_to").alias("a"), F.col("stop").alias("b"))))
    gone = conds.where("value IS NOT NULL").select("path", F.explode(cuts).alias("c")).select("path", "c.a", "c.b")
    gone = gone.unionByName(facts.where("to IS NOT NULL").select("path", F.col("at").alias("a"), F.col("to").alias("b")))
    edges = gone.select("path", F.explode(F.array(F.struct(F.col("a").alias("pos"), F.lit(1).alias("change")), F.struct(F.col("b").alias("pos"), F.lit(-1).alias("change")))).alias("e")).select("path", "e.pos", "e.change")
    edges = edges.groupBy("path", "pos").agg(F.sum("change").alias("change"))
    in_order = Window.partitionBy("path").orderBy("pos")
    kept = rows.join(edges, ["path", "pos"], "left").withColumn("open", F.sum(F.coalesce("change", F.lit(0))).over(in_order)).where("open = 0")
    glued = (F.lag("kind").over(in_order) == "word") & F.col("token").rlike(r"^\p{L}") & (F.lag("pos").over(in_order) + 1 != F.col("pos")) & ~F.lag("token").over(in_order).endswith("*")
    kept = kept.withColumn("token", F.when(glued, F.concat(F.lit(" "), "token")).otherwise(F.col("token")))
    whole = kept.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("parts"))
    whole = whole.select("path", F.array_join(F.transform("parts", lambda p: p["token"]), "").alias("_kept"))
    return sources.join(whole, "path", "left").withColumn("source", F.when(F.col("source").isNotNull(), F.coalesce("_kept", F.lit("")))).drop("_kept")
