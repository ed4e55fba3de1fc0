"""Queries over LaTeX sources that are made of pages: groups, definitions and conditionals, each beside its SQL.

A page's tags become commands and braces (or conditionals), so that nesting, and what is never closed, is the pages' own.
The SQL reads the tokens of a page in its own way: partners by the least position of a level, values of conditionals by a
walk over the tokens one after the other.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.operators import tree
from scriptorium.operators.structure import written
from scriptorium.plans.queries import query
from scriptorium.sources import conditionals, definitions, tokens

_ALONE, _TAG, _END = "<(b|br|meta)( [^>]*)?>", r"<([a-z][a-z0-9]*)[^>]*>", "</[a-z0-9]+>"


def _tex(c: str = "html"):
    ended = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), _END, "}"), _ALONE, r"\\$1 ")
    return F.regexp_replace(ended, _TAG, r"\\$1{")


_TEX = rf"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{_END}', '}}', 'g'), '{_ALONE}', '\\\1 ', 'g'), '{_TAG}', '\\\1{{', 'g')"
_TOKEN = r"%[^\n]*|\\[A-Za-z@]+\*?|\\(?s:.)|\\|[{}\[\]]|[ \t]+|\n|[^\\{}\[\]%\n \t]+"


def _levels(source: str) -> str:
    """Tokens of a SQL expression with the level of their braces."""
    return f"""t AS (
            SELECT page_id, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all({source}, '{_TOKEN}') AS ts FROM pages)
        ), l AS (
            SELECT *, sum(CASE token WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) + CASE token WHEN '}}' THEN 1 ELSE 0 END AS level FROM t
        ), g AS (
            SELECT o.page_id, o.pos AS open, min(c.pos) AS close, any_value(o.level) AS level FROM l o LEFT JOIN l c ON c.page_id = o.page_id AND c.token = '}}' AND c.level = o.level AND c.pos > o.pos
            WHERE o.token = '{{' GROUP BY 1, 2
        )"""


@query("group_partners", f"""
        WITH {_levels(_TEX)}
        SELECT g.page_id, g.open, g.close, CAST(g.level - 1 AS BIGINT) AS depth, max(p.open) AS parent
        FROM g LEFT JOIN g p ON p.page_id = g.page_id AND p.open < g.open AND p.level = g.level - 1 GROUP BY ALL""", "pages")  # fmt: skip
def _(pages):
    """Every pair of braces with its depth and the brace around it."""
    rows = tokens.nested(tokens.tokens(pages.select(F.col("page_id").alias("path"), _tex().alias("source"))))
    return tokens.groups(rows).withColumnRenamed("path", "page_id")


_MACROS = rf"'\newcommand{{\page}}[' || page_id % 10 || ']{{' || {_TEX} || '}} \def\next#1.{{' || {_TEX} || '}}'"


@query("macro_definitions", f"""
        WITH {_levels(_MACROS)}, d AS (
            SELECT g.page_id, t.pos AS at, CASE t.token WHEN '\\def' THEN 'def' ELSE 'newcommand' END AS command, g.open, g.close
            FROM t JOIN g ON g.page_id = t.page_id AND g.open = t.pos + CASE t.token WHEN '\\def' THEN 3 ELSE 7 END WHERE t.token IN ('\\def', '\\newcommand')
        )
        SELECT d.page_id, d.command, CASE d.command WHEN 'def' THEN 'next' ELSE 'page' END AS name, CAST(CASE d.command WHEN 'def' THEN 1 ELSE d.page_id % 10 END AS INTEGER) AS arity,
               CASE d.command WHEN 'def' THEN '#1.' END AS parameters, md5(coalesce(string_agg(b.token, '' ORDER BY b.pos), '')) AS body
        FROM d LEFT JOIN t b ON b.page_id = d.page_id AND b.pos > d.open AND b.pos < d.close WHERE d.close IS NOT NULL GROUP BY ALL""", "pages")  # fmt: skip
def _(pages):
    """Two definitions around a page, of which those count whose braces close."""
    key = F.col("page_id")
    source = F.concat(F.lit(r"\newcommand{\page}["), (key % 10).cast("string"), F.lit("]{"), _tex(), F.lit(r"} \def\next#1.{"), _tex(), F.lit("}"))
    found = definitions.macro_definitions(pages.select(key.alias("path"), source.alias("source")))
    return found.select(F.col("path").alias("page_id"), "command", "name", "arity", "parameters", F.md5(F.encode("body", "utf-8")).alias("body"))


_ENVIRONMENT = rf"'\newenvironment{{page}}[1][' || page_id || ']{{' || {_TEX} || '}} {{' || {_TEX} || '}}'"


@query("environment_definitions", f"""
        WITH {_levels(_ENVIRONMENT)}, d AS (
            SELECT a.page_id, a.open AS a, a.close AS b, e.open AS c, e.close AS d FROM g a JOIN g e ON e.page_id = a.page_id AND e.open = a.close + 2 WHERE a.open = 10 AND e.close IS NOT NULL
        )
        SELECT page_id, CAST(page_id AS VARCHAR) AS "default", md5(coalesce((SELECT string_agg(token, '' ORDER BY pos) FROM t WHERE t.page_id = d.page_id AND pos > a AND pos < b), '')) AS begins,
               md5(coalesce((SELECT string_agg(token, '' ORDER BY pos) FROM t WHERE t.page_id = d.page_id AND pos > c AND pos < d.d), '')) AS ends
        FROM d""", "pages")  # fmt: skip
def _(pages):
    key = F.col("page_id")
    source = F.concat(F.lit(r"\newenvironment{page}[1]["), key.cast("string"), F.lit("]{"), _tex(), F.lit("} {"), _tex(), F.lit("}"))
    found = definitions.environment_definitions(pages.select(key.alias("path"), source.alias("source")))
    return found.select(F.col("path").alias("page_id"), "default", F.md5(F.encode("begin", "utf-8")).alias("begins"), F.md5(F.encode("end", "utf-8")).alias("ends"))


#: Tags in the order in which they become conditionals.
_CONDITIONALS = [("%", ""), ("<p>", r"\ifdraft "), ("</p>", r"\fi "), ("<b>", r"\else "), ("<a [^>]*>", r"\drafttrue "), ("</a>", r"\draftfalse "), ("<li>", r"\iftrue "), ("</li>", r"\fi "), ("<nav>", r"\ifx "), ("</nav>", r"\fi "), ("<[^>]*>", "")]


def _conditional_sql() -> str:
    source = "coalesce(html, '')"
    for tag, word in _CONDITIONALS:
        source = f"regexp_replace({source}, '{tag}', '{word.replace(chr(92), chr(92) * 2)}', 'g')"
    return rf"'\newif\ifdraft ' || {source}"


@query("conditionals", rf"""
        WITH RECURSIVE t AS (
            SELECT page_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS i FROM (SELECT page_id, regexp_extract_all({_conditional_sql()}, '\\[A-Za-z@]+|[^\\]+') AS ts FROM pages)
        ), m AS (
            SELECT *, CASE WHEN i > 2 AND token IN ('\ifdraft', '\iftrue', '\ifx') THEN 1 WHEN token = '\fi' THEN -1 ELSE 0 END AS step FROM t
        ), l AS (
            SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY i) + CAST(step = -1 AS INTEGER) AS level FROM m
        ), c AS (
            SELECT l.*, step = 1 AND EXISTS (SELECT 1 FROM l e WHERE e.page_id = l.page_id AND e.step = -1 AND e.level = l.level AND e.i > l.i) AS ends FROM l
        ), w AS (
            SELECT page_id, CAST(0 AS BIGINT) AS i, '' AS token, CAST([] AS STRUCT(ends BOOLEAN, known BOOLEAN, val BOOLEAN, other BOOLEAN)[]) AS stack, false AS draft, false AS keep FROM t WHERE i = 1
            UNION ALL
            SELECT c.page_id, c.i, c.token,
                   CASE WHEN c.step = 1 THEN list_append(w.stack, {{'ends': c.ends, 'known': c.ends AND c.token <> '\ifx', 'val': c.token = '\iftrue' OR w.draft, 'other': false}})
                        WHEN c.step = -1 THEN w.stack[:-2]
                        WHEN c.token = '\else' AND len(w.stack) > 0 AND NOT w.stack[-1].other THEN list_append(w.stack[:-2], {{'ends': w.stack[-1].ends, 'known': w.stack[-1].known, 'val': w.stack[-1].val, 'other': true}})
                        ELSE w.stack END,
                   CASE WHEN c.token IN ('\drafttrue', '\draftfalse') AND len(list_filter(w.stack, lambda f: f.known AND f.val = f.other)) = 0 THEN c.token = '\drafttrue' ELSE w.draft END,
                   CASE WHEN c.i <= 2 OR c.token IN ('\drafttrue', '\draftfalse') THEN false
                        WHEN c.step = 1 THEN NOT (c.ends AND c.token <> '\ifx') AND len(list_filter(w.stack, lambda f: f.known AND f.val = f.other)) = 0
                        WHEN c.step = -1 THEN len(w.stack) = 0 OR (NOT w.stack[-1].known AND len(list_filter(w.stack[:-2], lambda f: f.known AND f.val = f.other)) = 0)
                        WHEN c.token = '\else' AND len(w.stack) > 0 AND NOT w.stack[-1].other THEN NOT w.stack[-1].known AND len(list_filter(w.stack, lambda f: f.known AND f.val = f.other)) = 0
                        ELSE len(list_filter(w.stack, lambda f: f.known AND f.val = f.other)) = 0 END
            FROM w JOIN c ON c.page_id = w.page_id AND c.i = w.i + 1
        ), o AS (
            SELECT page_id, i, keep, CASE WHEN lag(token) OVER (PARTITION BY page_id ORDER BY i) IN ('\drafttrue', '\draftfalse') THEN ltrim(token, ' ' || chr(9)) ELSE token END AS token FROM w WHERE i > 0
        )
        SELECT page_id, CAST(coalesce(sum(length(token)) FILTER (keep), 0) AS BIGINT) AS n_chars, md5(coalesce(string_agg(token, '' ORDER BY i) FILTER (keep), '')) AS digest FROM o GROUP BY 1""", "pages")  # fmt: skip
def _(pages):
    """Pages with the branches that TeX would take: list items are always taken, navigation is unknown, links set and unset what paragraphs ask."""
    source = F.coalesce("html", F.lit(""))
    for tag, word in _CONDITIONALS:
        source = F.regexp_replace(source, tag, word.replace("\\", "\\\\"))
    found = conditionals.resolved(pages.select(F.col("page_id").alias("path"), F.concat(F.lit(r"\newif\ifdraft "), source).alias("source")))
    return found.select(F.col("path").alias("page_id"), F.length("source").cast("long").alias("n_chars"), F.md5(F.encode("source", "utf-8")).alias("digest"))


def _nested(pages):
    return tokens.nested(tokens.tokens(pages.select(F.col("page_id").alias("path"), _tex().alias("source"))))


@query("tree_nodes", f"""
        WITH {_levels(_TEX)}, n AS (SELECT * FROM g WHERE close IS NOT NULL)
        SELECT n.page_id, row_number() OVER (PARTITION BY n.page_id ORDER BY n.open) - 1 AS pre, row_number() OVER (PARTITION BY n.page_id ORDER BY n.close) - 1 AS post, CAST(n.level - 1 AS BIGINT) AS depth,
               (SELECT count(*) FROM n d WHERE d.page_id = n.page_id AND d.open > n.open AND d.close < n.close) AS below,
               (SELECT count(*) FROM t WHERE t.page_id = n.page_id AND t.pos > n.open AND t.pos < n.close AND t.token IN ('\\a', '\\li')) > 0 AS any_link
        FROM n""", "pages")  # fmt: skip
def _(pages):
    """The closed groups of a page as nodes in pre- and post-order, how many they hold, and whether any item or link is among them."""
    rows = _nested(pages)
    found = tree.nodes(tokens.groups(rows)).withColumn("inside", F.col("open") + 1)
    words = rows.where(F.col("kind").isin("{", "word")).select("path", "pos", "kind", "token", F.col("partner").isNotNull().alias("closed"))
    out = tree.held(found, words, "path", "pos", "inside", "close", below=(F.col("kind") == "{") & F.col("closed"), links=F.col("token").isin(r"\a", r"\li"))
    return out.select(F.col("path").alias("page_id"), "pre", "post", "depth", "below", (F.col("links") > 0).alias("any_link"))


_STYLES = "('\\article', '\\div', '\\nav', '\\ul', '\\p')"


@query("inherited_styles", f"""
        WITH {_levels(_TEX)}, s AS (SELECT g.page_id, g.open, coalesce(g.close, 1000000000) AS close, t.token AS style FROM g JOIN t ON t.page_id = g.page_id AND t.pos = g.open - 1 AND t.token IN {_STYLES}),
        o AS (SELECT g.page_id, g.open, max(s.open) AS at FROM g LEFT JOIN s ON s.page_id = g.page_id AND g.open BETWEEN s.open AND s.close - 1 GROUP BY 1, 2)
        SELECT o.page_id, o.open, s.style FROM o LEFT JOIN s ON s.page_id = o.page_id AND s.open = o.at""", "pages")  # fmt: skip
def _(pages):
    """The style of each group: its own, where the command before it has one, or that of the nearest group around it."""
    before = Window.partitionBy("path").orderBy("pos")
    own = F.when((F.lag("kind").over(before) == "word") & F.lag("token").over(before).isin(r"\article", r"\div", r"\nav", r"\ul", r"\p"), F.lag("token").over(before))
    rows = _nested(pages).withColumn("style", own).where("kind = '{'")
    groups = written(rows.select("path", F.col("pos").alias("open"), F.coalesce("partner", F.lit(1_000_000_000)).alias("close"), "style"))
    found = tree.innermost(groups.drop("style"), groups.where("style IS NOT NULL"), "path", "open", "open", "close", ["style"])
    return found.select(F.col("path").alias("page_id"), "open", "style")


@query("declarations_in_force", f"""
        WITH {_levels(_TEX)}, d AS (
            SELECT t.page_id, t.pos, coalesce((SELECT min(coalesce(g.close, 1000000000)) FROM g WHERE g.page_id = t.page_id AND g.open < t.pos AND coalesce(g.close, 1000000000) > t.pos), 1000000000) AS until FROM t WHERE t.token IN ('\\b', '\\br', '\\meta')
        )
        SELECT w.page_id, w.pos, max(d.pos) AS declared FROM t w LEFT JOIN d ON d.page_id = w.page_id AND d.pos <= w.pos AND d.until > w.pos WHERE w.token LIKE '\\%' AND length(w.token) > 2 GROUP BY 1, 2""", "pages")  # fmt: skip
def _(pages):
    """The declaration that holds at each command: the last in its group, else the last before that group in the one around it, and so on."""
    # a group's brace and what stands in it side by side: a join would shuffle the tokens anew
    rows = _nested(pages).where(F.col("kind").isin("{", "word")).withColumn("in", F.when(F.col("kind") == "{", F.col("pos")).otherwise(F.col("group")))
    close = F.max(F.when(F.col("kind") == "{", F.col("partner"))).over(Window.partitionBy("path", "in"))
    until = F.when(F.col("token").isin(r"\b", r"\br", r"\meta"), F.coalesce(close, F.lit(1_000_000_000)))
    rows = written(rows.withColumn("until", until).where("kind = 'word'").select("path", "pos", "until", (F.length("token") > 2).alias("long")))
    words, spans = rows.where("long").select("path", "pos"), rows.where("until IS NOT NULL").select("path", F.col("pos").alias("declared"), "until")
    return tree.innermost(words, spans, "path", "pos", "declared", "until", ["declared"]).select(F.col("path").alias("page_id"), "pos", "declared")
