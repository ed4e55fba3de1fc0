"""Tokens, groups, definitions and conditionals of random sources against readers that go character by character."""

import random
import re

from scriptorium.sources import conditionals, definitions, tokens

RNG = random.Random(11)
PIECES = ["{", "}", "[", "]", "\\a", "\\bb*", "\\{", "\\}", "\\\\", "x", "yz ", " ", "\n", "% no {\n", "\\%", "\\verb|}{|", "\\begin{verbatim}} {\\end{verbatim}", "é"]


def frame(spark, sources):
    return spark.createDataFrame(list(enumerate(sources)), "path long, source string").repartition(3)


def closing(source, at):
    """The place of the brace that closes the one at a place, or None."""
    depth, i = 0, at
    while i < len(source):
        if source[i] == "%":
            i = source.find("\n", i)
            if i < 0:
                return None
        elif source.startswith("\\verb|", i):
            i = source.index("|", i + 6)
        elif source.startswith("\\begin{verbatim}", i):
            i = source.index("\\end{verbatim}", i) + 13
        elif source[i] == "\\":
            i += 1
        elif source[i] == "{":
            depth += 1
        elif source[i] == "}":
            depth -= 1
            if depth == 0:
                return i
        i += 1
    return None


def test_partners(spark):
    sources = ["".join(RNG.choice(PIECES) for _ in range(RNG.randrange(40))) for _ in range(300)] + ["{" * 300 + "x" + "}" * 299, "}" * 50 + "{}", "", None]
    rows = tokens.nested(tokens.tokens(frame(spark, sources))).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path, {})[r.pos] = r
    for path, source in enumerate(sources):
        own = by.get(path, {})
        assert "".join(own[i].token for i in sorted(own)) == (source or "")
        for r in own.values():
            assert source[r.start : r.stop] == r.token
            if r.kind == "{":
                assert (own[r.partner].start if r.partner is not None else None) == closing(source, r.start)
            inside = [o.pos for o in own.values() if o.kind == "{" and o.pos < r.pos and (o.partner is None or o.partner > r.pos)]
            assert r.group == (max(inside) if inside else None)


def test_definitions_to_any_depth(spark):
    deep = "{" * 12 + "x" + "}" * 12
    source = rf"""% \newcommand{{\no}}{{a}}
\newcommand*{{\deep}}[2][{deep}]{{#1 {deep} \{{}} \def\pair(#1,#2){{<#1|#2>}} \let\old=\section \let\other\emph
\newcommand\bold\textbf \NewDocumentCommand{{\doc}}{{s O{{a{{b}}}} m r()}}{{body {deep}}}
\newcommand{{\outer}}{{\newcommand{{\inner}}{{in}}}} \verb|\newcommand{{\v}}{{a}}|
\newenvironment{{box}}[1][{{d}}]{{\begin{{quote}} {deep}}}
  {{\end{{quote}}}} \newcommand{{\open}}{{never \newcommand{{\late}}{{l}}"""
    got = {r.name: r for r in definitions.macro_definitions(frame(spark, [source])).collect()}
    assert sorted(got) == ["bold", "deep", "doc", "late", "old", "other", "outer", "pair"]
    assert (got["deep"].arity, got["deep"].default, got["deep"].body) == (2, deep, f"#1 {deep} \\{{")
    assert (got["pair"].command, got["pair"].arity, got["pair"].parameters, got["pair"].body) == ("def", 2, "(#1,#2)", "<#1|#2>")
    assert [got[n].body for n in ("old", "other", "bold")] == [r"\section", r"\emph", r"\textbf"]
    assert (got["doc"].arity, got["doc"].spec, got["doc"].body) == (4, "s O{a{b}} m r()", f"body {deep}")
    assert got["outer"].body == r"\newcommand{\inner}{in}"
    (box,) = definitions.environment_definitions(frame(spark, [source])).collect()
    assert (box.name, box.arity, box.default, box.begin, box.end) == ("box", 1, "{d}", rf"\begin{{quote}} {deep}", r"\end{quote}")


WORDS = [r"\newif\ifa ", r"\newif\ifb ", r"\atrue ", r"\afalse ", r"\btrue", r"\ifa ", r"\ifb", r"\iftrue ", r"\iffalse", r"\ifx ", r"\else ", r"\fi", r"\fi ", "t", "u ", "\n", r"\foo", r"\def\q{}", r"\ifdefined\q ", r"\ifdefined\par", r"\verb|\fi|", "% \\fi\n", r"\newtoggle{t}", r"\toggletrue{t}", r"\providetoggle{t}", r"\iftoggle{t}{A}{B}", r"\nottoggle{t}{\btrue C}{\iftrue D\fi}", r"\ifthenelse{\not\equal{x}{ x }}{E}{F}"]
TOKEN = re.compile(r"\\verb\|[^|\n]*\||%[^\n]*|\\[A-Za-z@]+|(?s:\\.)|[ \t]+|\n|[{}]|[^\\{}%\n \t]+")


class Walk:
    """A source read once from left to right."""

    def __init__(self, source):
        self.t = TOKEN.findall(source)
        self.switches = {"a", "b"} & {m for m in re.findall(r"\\newif\s*\\if([ab])", re.sub(r"%[^\n]*|\\verb\|[^|]*\|", "", source))}
        self.values, self.toggles, self.defined, self.out = dict.fromkeys(self.switches, False), {}, set(), []
        self.go(0, len(self.t))

    def solid(self, i):
        while i < len(self.t) and (self.t[i].isspace() or self.t[i][0] == "%"):
            i += 1
        return i

    def opens(self, i):
        w = self.t[i]
        before = i - 1
        while before >= 0 and (self.t[before].isspace() or self.t[before][0] == "%"):
            before -= 1
        return (w in (r"\iftrue", r"\iffalse", r"\ifx", r"\ifdefined") or w[3:] in self.switches and w[:3] == r"\if") and not (before >= 0 and self.t[before] == r"\newif")

    def end(self, i):
        """Places of \\else and \\fi."""
        depth, other = 1, None
        for j in range(i + 1, len(self.t)):
            if self.opens(j):
                depth += 1
            elif self.t[j] == r"\fi":
                depth -= 1
                if not depth:
                    return other, j
            elif self.t[j] == r"\else" and depth == 1 and other is None:
                other = j
        return None

    def group(self, i):
        i = self.solid(i)
        if i >= len(self.t) or self.t[i] != "{":
            return None
        depth = 0
        for j in range(i, len(self.t)):
            depth += (self.t[j] == "{") - (self.t[j] == "}")
            if not depth:
                return i + 1, j
        return None

    def keep(self, i):
        if self.out and re.fullmatch(r"\\[A-Za-z@]+", self.out[-1][1]) and self.t[i][0].isalpha() and self.out[-1][0] + 1 != i:
            self.out.append((i, " "))
        self.out.append((i, self.t[i]))

    def go(self, i, stop):
        while i < stop:
            w = self.t[i]
            if w == r"\newif":
                i = self.solid(i + 1) + 1
                self.defined.add(self.t[i - 1][1:] if i <= len(self.t) else "")
                continue
            if w[1:-4] in self.switches and w.endswith("true") or w[1:-5] in self.switches and w.endswith("false"):
                name = w[1:-4] if w.endswith("true") else w[1:-5]
                self.values[name] = w.endswith("true")
                i += 1 + (i + 1 < len(self.t) and self.t[i + 1] != "\n" and self.t[i + 1].isspace())
                continue
            if w in (r"\newtoggle", r"\toggletrue", r"\providetoggle"):
                i = self.group(i + 1)[1] + 1
                self.toggles["t"] = self.toggles.get("t", False) if w == r"\providetoggle" else w == r"\toggletrue"
                continue
            if w == r"\def":
                self.defined.add("q")
            if w in (r"\iftoggle", r"\nottoggle", r"\ifthenelse"):
                a = self.group(i + 1)
                value = True if w == r"\ifthenelse" else self.toggles.get("t")
                if w == r"\ifthenelse":
                    value = False  # not (x equals x)
                if value is not None:
                    one, two = self.group(a[1] + 1), None
                    two = self.group(one[1] + 1)
                    self.go(*(one if value != (w == r"\nottoggle") else two))
                    i = two[1] + 1
                    continue
            if self.opens(i) and (ends := self.end(i)):
                other, fi = ends
                value, head = {r"\iftrue": True, r"\iffalse": False}.get(w), i + 1
                if w[3:] in self.switches:
                    value = self.values[w[3:]]
                if w == r"\ifdefined":
                    head = self.solid(i + 1)
                    value = self.t[head] == r"\par" or self.t[head][1:] in self.defined
                    head += 1
                if value is None:
                    self.keep(i)
                    self.go(i + 1, other if other is not None else fi)
                    if other is not None:
                        self.keep(other)
                        self.go(other + 1, fi)
                    self.keep(fi)
                elif value:
                    self.go(head, other if other is not None else fi)
                elif other is not None:
                    self.go(other + 1, fi)
                i = fi + 1
                continue
            self.keep(i)
            i += 1


def test_conditionals(spark):
    sources = ["".join(RNG.choice(WORDS) for _ in range(RNG.randrange(1, 30))) for _ in range(400)]
    sources += ["".join(rf"\newif\if{c} " for c in "ab") + "".join(r"\ifa\btrue\else\bfalse\fi\ifb\afalse\else\atrue\fi" for _ in range(12)) + r"\ifa X\else Y\fi", "", "plain", r"\foo\iftrue bar\fi"]
    got = {r.path: r.source for r in conditionals.resolved(frame(spark, [*sources, None])).collect()}
    assert got[len(sources)] is None
    for path, source in enumerate(sources):
        assert got[path] == "".join(x for _, x in Walk(source).out), source


def test_verbatim_is_left_alone(spark):
    from pyspark.sql import functions as F

    source = "a \\hskip 1pt b \\begin{verbatim}\\hskip 1pt\\end{verbatim} \\verb|\\vskip 2pt| \\vskip 2pt"
    c = tokens.outside_verbatim(F.col("source"), definitions.without_glue)
    assert frame(spark, [source]).select(c.alias("s")).first().s == "a  b \\begin{verbatim}\\hskip 1pt\\end{verbatim} \\verb|\\vskip 2pt| "


def test_tokens_are_dealt_over_more_tasks_as_sources_grow(spark, monkeypatch):
    from scriptorium.sources import tokens

    monkeypatch.setattr(tokens, "PART", 100)
    sources = spark.range(100).selectExpr("id AS path", "repeat('{a}', 20) AS source")
    rows = tokens.nested(tokens.tokens(sources))
    assert rows.select("path", "depth").rdd.getNumPartitions() == 100 * 76 // 100 + 1
    assert tokens.groups(rows).where("close = open + 2 AND depth = 0").count() == 2000


def test_commands_around_names_are_those_of_all_tokens(spark):
    pieces = [*PIECES, "\\a", "\\a ", "\\a*", "\\bb{x}", "[o]", "\\verb@x{@", "}", "\r"]
    sources = ["".join(RNG.choice(pieces) for _ in range(RNG.randrange(60))) for _ in range(400)] + ["} \\a{b} } \\c \\a[", "{\\a {\\a", "x", "", None]
    named = "trim(TRAILING '*' FROM name) = 'a' OR trim(TRAILING '*' FROM before) = '\\\\a'"
    spans = "transform(args, a -> struct(a.kind AS kind, a.from AS from, a.to AS to)) AS args"
    columns = ["path", "name", "start", "stop", "before", "then", "then2", "brace.kind", "brace.from", "brace.to", spans]
    every = tokens.commands(tokens.nested(tokens.tokens(frame(spark, sources)))).where(named).selectExpr(*columns).collect()
    some = definitions.found_commands(frame(spark, sources), ["a"]).where(named).selectExpr(*columns).collect()
    assert len(every) > 300 and sorted(map(str, some)) == sorted(map(str, every))


def test_what_bodies_hold_is_no_row_of_definitions(spark):
    body = "\\p{x y \\b{z}} " * 500
    rows = tokens.around(frame(spark, [rf"\newcommand{{\page}}[3]{{{body}}} \def\next#1.{{{body}}}"] * 3), definitions.COMMANDS)
    assert rows.count() == 3 * 10  # both words, \next, #1., [, 3, ], three groups
