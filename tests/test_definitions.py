"""Definitions of a small LaTeX source, rewrites of sources, and reconciliation against difflib."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import reconcile
from scriptorium.plans import queries as plans
from scriptorium.sources import definitions as D

DATA = "/root/testdata/sf0.001"
SOURCE = r"""\newcommand{\R}{\mathbb{R}} \newcommand\norm[1]{\lVert #1 \rVert}
\providecommand{\R}{never} \renewcommand{\norm}[2][2]{\lVert #2 \rVert_{#1}} \providecommand*{\new}{\textbf{a {b}}}
\newcommand{\self}{\self x} \newcommand{\inner}{\a@b}
\newtheorem{theorem}{Theorem}[section] \newtheorem{lemma}[theorem]{Lemma} \newtheorem*{remark}{Remark}
\newacronym{gpu}{GPU}{graphics {processing} unit}
\definecolor{sea}{RGB}{0, 80, 160}
\begin{thebibliography}{9}
\bibitem{one} A. Author.
  First   work.
\bibitem[{B (2001)}]{two} Second.
\end{thebibliography}"""


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([("p", SOURCE), ("empty", ""), ("none", None)], "path string, source string")


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_macros(sources):
    got = D.macros(D.macro_definitions(sources))
    assert sorted(rows(got, "name", "arity", "default", "body")) == [
        ("R", 0, None, r"\mathbb{R}"),
        ("inner", 0, None, r"\a@b"),
        ("new", 0, None, r"\textbf{a {b}}"),
        ("norm", 2, "2", r"\lVert #2 \rVert_{#1}"),
        ("self", 0, None, r"\self x"),
    ]
    assert sorted(rows(D.safe_macros(got, ["new"]), "name")) == [("R",), ("norm",)]


def test_collectors(sources):
    assert rows(D.theorem_kinds(sources).orderBy("pos"), "name", "numbered", "shared", "title", "within") == [
        ("theorem", True, "", "Theorem", "section"),
        ("lemma", True, "theorem", "Lemma", ""),
        ("remark", False, "", "Remark", ""),
    ]
    assert rows(D.acronyms(sources), "key", "short", "long") == [("gpu", "GPU", "graphics {processing} unit")]
    assert rows(D.colours(sources), "name", "model", "spec") == [("sea", "RGB", "0, 80, 160")]
    assert rows(D.bibliography_items(sources).orderBy("number"), "number", "key", "label", "text") == [
        (1, "one", None, "A. Author. First work."),
        (2, "two", "{B (2001)}", "Second."),
    ]


def test_lists_and_priorities(spark):
    files = spark.createDataFrame([("a/x.bbl", "a"), ("b/x.bbl", "b"), ("b/y.bbl", "b")], "path string, dir string")
    assert rows(D.sole_lists(files), "path") == [("a/x.bbl",)]
    items = spark.createDataFrame([("p", "k", 1, "file"), ("p", "k", 2, "body"), ("p", "m", 1, "file")], "path string, key string, priority int, text string")
    assert sorted(rows(D.preferred_items(items), "key", "text")) == [("k", "body"), ("m", "file")]


@pytest.mark.parametrize(
    ("rewrite", "before", "after"),
    [
        (D.starred_outside, r"\begin*{align}x\end*{align}", r"\begin{align*}x\end{align*}"),
        (D.operators_as_commands, r"\DeclareMathOperator*{\argmax}{arg\,max}", r"\newcommand{\argmax}{\operatorname*{arg\,max}}"),
        (D.listings_as_verbatim, "\\begin{minted}[linenos]{c}\nx\n\\end{minted}", "\\begin{verbatim}\nx\n\\end{verbatim}"),
        (D.without_glue, r"a\vskip 2pt plus 1fil minus .5pt b", "a b"),
    ],
)
def test_rewrites(spark, rewrite, before, after):
    df = spark.createDataFrame([(before,), ("plain",), (None,)], "source string")
    assert [r[0] for r in df.select(rewrite(F.col("source"))).collect()] == [after, "plain", None]


def test_reconcile(spark):
    got = {}
    for r in plans.QUERIES["reconcile"](spark, DATA).orderBy("conv_id", "step").collect():
        got.setdefault(r["conv_id"], []).append((r["tag"], r["old_from"], r["old_to"], r["new_from"], r["new_to"]))
    norm = lambda r: (r["role"], " ".join((r["text"] or "").split()))
    want, chats = {}, {}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect():
        chats.setdefault(r["conv_id"], []).append(r)
    for conv, turns in chats.items():
        old, new = [norm(r) for r in turns if r["turn"] % 3 != 2], [norm(r) for r in turns if r["turn"] % 4 != 1]
        if old or new:
            want[conv] = SequenceMatcher(None, old, new, autojunk=False).get_opcodes()
    assert got == want


def test_grafted(spark):
    kept = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "doc long, text string")
    edited = spark.createDataFrame([(1, "a"), (1, "c")], "doc long, text string")
    assert sorted(rows(reconcile.grafted(kept, edited, "doc", "text"), "doc", "text")) == [(1, "a"), (1, "b"), (1, "c"), (2, "a")]
