"""Queries over the given tables, one for each operator, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import blocks, citations, findings, numbering, refs, tables
from scriptorium.sources import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None, *names: str):
    """Register a function of the named tables as a query, with SQL if that can say the same."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names))
        if sql:
            SQL[name] = sql
        return f

    return put


# constructs of pages


@query("construct_histogram", "SELECT construct, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS construct FROM pages) GROUP BY 1", "pages")
def _(pages):
    return blocks.constructs(pages).groupBy("construct").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query("construct_top40", "SELECT construct, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS construct FROM pages) GROUP BY 1 ORDER BY n DESC, construct LIMIT 40", "pages")
def _(pages):
    return blocks.constructs(pages).groupBy("construct").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "construct").limit(40)


_COUNTS = "SELECT page_id, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, len(regexp_extract_all(html, '<h1[ >]')) AS headings, len(regexp_extract_all(html, '<li[ >]')) AS items, len(regexp_extract_all(html, '<a[ >]')) AS links FROM pages"


@query("coverage_by_page", f"SELECT *, paragraphs + headings + items AS blocks, CASE WHEN paragraphs + headings + items = 0 THEN 100.0 ELSE round(100.0 * paragraphs / (paragraphs + headings + items), 4) END AS paragraph_share FROM ({_COUNTS})", "pages")
def _(pages):
    return blocks.coverage(pages)


@query("coverage_corpus", f"SELECT count(*) AS pages, CAST(sum(paragraphs) AS BIGINT) AS paragraphs, CAST(sum(paragraphs + headings + items) AS BIGINT) AS blocks, CASE WHEN sum(paragraphs + headings + items) = 0 THEN 100.0 ELSE round(100.0 * sum(paragraphs) / sum(paragraphs + headings + items), 4) END AS share FROM ({_COUNTS})", "pages")
def _(pages):
    total = blocks.coverage(pages).agg(F.count("*").alias("pages"), F.sum("paragraphs").alias("paragraphs"), F.sum("blocks").alias("blocks"))
    return total.withColumn("share", F.when(F.col("blocks") == 0, 100.0).otherwise(F.round(100.0 * F.col("paragraphs") / F.col("blocks"), 4)))


@query("link_targets", """SELECT target, starts_with(target, '/') AS internal, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) GROUP BY 1, 2""", "pages")
def _(pages):
    return blocks.links(pages).groupBy("target", "internal").agg(F.count("*").alias("n"))


@query("plain_text", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[^<]*</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'), ' ')) AS text_md5 FROM pages", "pages")
def _(pages):
    return pages.select("page_id", F.md5(F.encode(T.without_tags(F.col("html")), "utf-8")).alias("text_md5"))


@query("bookmark_sanitize", "WITH c AS (SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g') AS name FROM pages) SELECT page_id, substring(CASE WHEN regexp_matches(name, '^[A-Za-z]') THEN name ELSE 'ref_' || name END, 1, 40) AS bookmark FROM c", "pages")
def _(pages):
    return pages.select("page_id", T.bookmark(F.col("url")).alias("bookmark"))


# texts of documents


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"
_NORMAL = "trim(regexp_replace({}, '[ \\t\\n\\r]+', ' ', 'g'), ' ')"


@query("doc_blocks", f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, {_NORMAL.format('raw')} AS block FROM ({_LINES}) WHERE {_NORMAL.format('raw')} <> ''", "documents")
def _(documents):
    return blocks.blocks(documents)


@query("normalize_ws", f"SELECT doc_id, md5({_NORMAL.format('text')}) AS text_md5, length({_NORMAL.format('text')}) AS n FROM documents", "documents")
def _(documents):
    text = T.normal_space(F.col("text"))
    return documents.select("doc_id", F.md5(F.encode(text, "utf-8")).alias("text_md5"), F.length(text).cast("long").alias("n"))


_ESCAPED = "replace(text, '#', '\\%')"


@query("strip_percent_comments", f"SELECT doc_id, md5(replace(regexp_replace(replace({_ESCAPED}, '\\%', chr(1)), '%[^\\n]*\\n?[ \\t]*', '', 'g'), chr(1), '\\%')) AS text_md5 FROM documents", "documents")
def _(documents):
    """Texts, of which each number sign became an escaped per cent sign, without comments."""
    escaped = F.replace("text", F.lit("#"), F.lit("\\%"))
    return documents.select("doc_id", F.md5(F.encode(corpus.without_comments(escaped), "utf-8")).alias("text_md5"))


@query("html_escape", "SELECT doc_id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS text_md5 FROM documents", "documents")
def _(documents):
    return documents.select("doc_id", F.md5(F.encode(T.html_escape(F.col("text")), "utf-8")).alias("text_md5"))


def _latex_sql() -> str:
    c = "text"
    for i, (a, _) in enumerate(T.LATEX):
        c = f"replace({c}, '{a}', chr({0xE000 + i}))"
    for i, (_, b) in enumerate(T.LATEX):
        c = f"replace({c}, chr({0xE000 + i}), '{b}')"
    return f"SELECT doc_id, md5({c}) AS text_md5 FROM documents"


@query("latex_escape", _latex_sql(), "documents")
def _(documents):
    return documents.select("doc_id", F.md5(F.encode(T.latex_escape(F.col("text")), "utf-8")).alias("text_md5"))


@query("kwic", "SELECT doc_id, instr(text, ' the ') AS at, substring(text, greatest(instr(text, ' the ') - 30, 1), 65) AS context FROM documents WHERE instr(text, ' the ') > 0", "documents")
def _(documents):
    at = F.instr("text", " the ")
    return documents.where(at > 0).select("doc_id", at.cast("long").alias("at"), F.substring("text", F.greatest(at - 30, F.lit(1)), F.lit(65)).alias("context"))


@query("leak_tokens", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]{5,}|[A-Za-z0-9.]+@[A-Za-z0-9.]+'))), ' ') AS tokens FROM documents WHERE regexp_matches(text, '[0-9]{5,}|[A-Za-z0-9.]+@[A-Za-z0-9.]+')", "documents")
def _(documents):
    pattern = "[0-9]{5,}|[A-Za-z0-9.]+@[A-Za-z0-9.]+"
    found = documents.where(F.col("text").rlike(pattern))
    return found.select("doc_id", F.array_join(F.sort_array(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 0))), " ").alias("tokens"))


@query("media_dedup", "SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS media_id FROM documents", "documents")
def _(documents):
    return findings.first_copies(documents)


@query("block_signature", f"SELECT signature, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, md5(lower({_NORMAL.format('raw')})) AS signature FROM ({_LINES}) WHERE {_NORMAL.format('raw')} <> '') GROUP BY 1", "documents")
def _(documents):
    rows = blocks.blocks(documents).select("doc_id", F.md5(F.encode(F.lower("block"), "utf-8")).alias("signature"))
    return rows.groupBy("signature").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


# numbers, names, colours


@query("num_group_digits", "SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS grouped FROM orders", "orders")
def _(orders):
    return orders.select("o_orderkey", T.grouped_digits(F.floor("o_totalprice")).alias("grouped"))


@query("length_to_emu", "SELECT p_partkey, " + ", ".join(f"CAST(round(p_size * CAST({emu} AS DOUBLE)) AS BIGINT) AS {unit}_emu" for unit, emu in (("in", "914400"), ("cm", "360000"), ("mm", "36000"), ("pt", "914400 / 72.27"), ("bp", "12700"), ("px", "9525"), ("em", "9144000 / 72.27"), ("ex", "3931920 / 72.27"))) + " FROM part", "part")
def _(part):
    return part.select("p_partkey", *(F.round(T.to_emu(F.col("p_size"), unit)).cast("long").alias(f"{unit}_emu") for unit in T.EMU))


_CHANNEL = "lpad(upper(to_hex(CAST(round_even(({} * p_size + {} * (100 - p_size)) / 100.0, 0) AS BIGINT))), 2, '0')"


@query("color_mix", "SELECT p_partkey, " + " || ".join(_CHANNEL.format(f"((p_partkey * {k}) % 256)", b) for k, b in ((1, 255), (7, 0), (13, 128))) + " AS colour FROM part", "part")
def _(part):
    a = [F.pmod(F.col("p_partkey") * k, F.lit(256)) for k in (1, 7, 13)]
    return part.select("p_partkey", T.mixed_colour(a, [F.lit(255), F.lit(0), F.lit(128)], F.col("p_size")).alias("colour"))


@query("author_initials", "SELECT p_partkey, upper(p_name[1]) || '. ' || upper(split_part(p_name, ' ', 2)[1]) || '.' AS initials FROM part", "part")
def _(part):
    return part.select("p_partkey", T.initials(F.col("p_name")).alias("initials"))


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", "events")
def _(events):
    return events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# labels and references


@query("label_registry", "SELECT user_id, event_type, event_id, value, definitions FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS definitions, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC, value DESC) AS k FROM events) WHERE k = 1", "events")
def _(events):
    named = events.withColumn("key", F.struct("user_id", "event_type"))
    return refs.registry(named, "key", "ts", "event_id", "value").select("key.*", "event_id", "value", "definitions")


@query("ref_resolve", "SELECT l_orderkey, l_partkey, l_suppkey, o_orderpriority IS NOT NULL AS found, o_orderpriority FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey", "lineitem", "orders")
def _(lineitem, orders):
    out = refs.resolved(lineitem.select("l_orderkey", "l_partkey", "l_suppkey"), orders.where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderpriority"), "l_orderkey", "o_orderkey")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", F.col("o_orderpriority").isNotNull().alias("found"), "o_orderpriority")


@query("ref_dangling", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1", "lineitem", "orders")
def _(lineitem, orders):
    return refs.dangling(lineitem, orders.where("o_orderstatus <> 'P'").select("o_orderkey"), "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("alias_expand", "WITH labels AS (SELECT s_name AS key, s_nationkey FROM supplier WHERE s_acctbal >= 0), aliases AS (SELECT a.s_name AS alias, b.s_name AS kept FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey - 1) SELECT * FROM labels UNION ALL SELECT alias, l.s_nationkey FROM aliases JOIN labels l ON kept = l.key WHERE alias NOT IN (SELECT key FROM labels)", "supplier")
def _(supplier):
    labels = supplier.where("s_acctbal >= 0").select(F.col("s_name").alias("key"), "s_nationkey")
    before = supplier.select((F.col("s_suppkey") + 1).alias("s_suppkey"), F.col("s_name").alias("kept"))
    return refs.with_aliases(labels, supplier.join(before, "s_suppkey").select(F.col("s_name").alias("alias"), "kept"), "key", "alias", "kept")


@query("style_merge", "SELECT c_nationkey AS nation, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer) GROUP BY 1", "customer", "supplier")
def _(customer, supplier):
    count = lambda df, c: df.groupBy(F.col(c).alias("nation")).agg(F.count("*").alias("n"))
    return refs.merged(count(supplier, "s_nationkey"), count(customer, "c_nationkey"), "nation")


@query("integrity_missing", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')", "customer", "orders")
def _(customer, orders):
    return refs.dangling(customer, orders.where("o_orderpriority = '1-URGENT'").select("o_custkey"), "c_custkey", "o_custkey").select("c_custkey")


# counters and running state


@query("seq_counter", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS number FROM events", "events")
def _(events):
    return numbering.counter(events, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", F.col("number").cast("long").alias("number"))


_SECTIONS = "SELECT *, CAST(sum(CAST(event_type = 'signup' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS section_number FROM events"


@query("seq_reset_by_section", f"SELECT event_id, section_number, CASE WHEN event_type = 'click' THEN CAST(sum(CAST(event_type = 'click' AS INTEGER)) OVER (PARTITION BY user_id, section_number ORDER BY ts, event_id) AS BIGINT) END AS number FROM ({_SECTIONS})", "events")
def _(events):
    return numbering.reset_counter(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "click").select("event_id", "section_number", "number")


@query("heading_multilevel", f"SELECT event_id, section_number || '.' || count(*) FILTER (event_type = 'view') OVER (PARTITION BY user_id, section_number ORDER BY ts, event_id) AS number FROM ({_SECTIONS})", "events")
def _(events):
    rows = numbering.reset_counter(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.lit(True))
    w = numbering.running(numbering.Window.partitionBy("user_id", "section_number").orderBy("ts", "event_id"))
    return rows.select("event_id", F.concat_ws(".", "section_number", F.count_if(F.col("event_type") == "view").over(w)).alias("number"))


@query("nearest_heading", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS heading FROM events", "events")
def _(events):
    return numbering.last_seen(events, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "heading").select("event_id", "heading")


@query("switch_state", "SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN true WHEN event_type = 'error' THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS on_ FROM events", "events")
def _(events):
    value = F.when(F.col("event_type") == "signup", True).when(F.col("event_type") == "error", False)
    return numbering.last_seen(events, ["user_id"], ["ts", "event_id"], value, "on_").select("event_id", F.coalesce("on_", F.lit(False)).alias("on_"))


@query("first_use", "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1", "events")
def _(events):
    return numbering.counter(events, ["user_id", "event_type"], ["ts", "event_id"]).where("number = 1").select("event_id", "user_id", "event_type")


@query("consecutive_runs", "WITH m AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS new FROM events)) SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS length FROM m GROUP BY 1, 2", "events")
def _(events):
    return numbering.runs(events, ["user_id"], ["ts", "event_id"], "event_type").drop("first")


@query("column_breaks", "SELECT conv_id, turn FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL AND before <> role", "conversations")
def _(conversations):
    return numbering.runs(conversations, ["conv_id"], ["turn"], "role").where("run > 1").select("conv_id", F.col("first").alias("turn"))


@query("footnote_fifo", """
        WITH RECURSIVE r AS (
            SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('view', 'click')
        ), w AS (
            SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS queue, CAST(NULL AS BIGINT) AS mark, CAST(NULL AS BIGINT) AS body FROM r
            UNION ALL
            SELECT r.user_id, r.n, CASE WHEN event_type = 'view' THEN list_append(queue, CAST(event_id AS BIGINT)) ELSE queue[2:] END,
                   CASE WHEN event_type = 'click' THEN queue[1] END, CASE WHEN event_type = 'click' THEN event_id END
            FROM w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1
        )
        SELECT mark, body FROM w WHERE body IS NOT NULL
        UNION ALL SELECT event_id, NULL FROM r WHERE event_type = 'view' AND event_id NOT IN (SELECT mark FROM w WHERE mark IS NOT NULL)""", "events")  # fmt: skip
def _(events):
    pairs = numbering.queued(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", F.col("event_type") == "click", "event_id")
    return pairs.select(F.col("mark").cast("long").alias("mark"), F.col("text").cast("long").alias("body"))


@query("order_check", "SELECT event_id FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE value < before", "events")
def _(events):
    before = F.lag("value").over(numbering.Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.withColumn("before", before).where("value < before").select("event_id")


# citations and tables


_CITES = "SELECT l_orderkey, l_partkey, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2"


@query("cite_first_seen_order", f"SELECT l_orderkey, l_partkey, pos AS first_pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos, l_partkey) AS number FROM ({_CITES})", "lineitem")
def _(lineitem):
    return citations.first_seen(lineitem, "l_orderkey", "l_partkey", "l_linenumber").withColumn("number", F.col("number").cast("long"))


@query("cite_render_numeric", f"SELECT l_orderkey, '[' || string_agg(number, ', ' ORDER BY number) || ']' AS label FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos, l_partkey) AS number FROM ({_CITES})) GROUP BY 1", "lineitem")
def _(lineitem):
    return citations.rendered(lineitem, "l_orderkey", "l_partkey", "l_linenumber")


#: Letters of n, the last one first: each stands for the numbers from the least that has it (1, 27, 703 and so on), z is followed by aa.
_LETTERS = " || ".join(f"CASE WHEN n >= {least} THEN chr(CAST(97 + (n - {least}) // {26**i} % 26 AS INTEGER)) ELSE '' END" for i, least in reversed([(i, sum(26**j for j in range(i + 1))) for i in range(13)]))


@query("bibliography_author_year", f"SELECT s_suppkey, n_name, CASE WHEN items > 1 THEN {_LETTERS} ELSE '' END AS letter FROM (SELECT s_suppkey, n_name, count(*) OVER (PARTITION BY n_name, s_suppkey % 5) AS items, row_number() OVER (PARTITION BY n_name, s_suppkey % 5 ORDER BY s_suppkey) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey)", "supplier", "nation")
def _(supplier, nation):
    items = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).withColumn("year", F.col("s_suppkey") % 5)
    return citations.year_letters(items, "n_name", "year", "s_suppkey").select("s_suppkey", "n_name", "letter")


_CELLS = "SELECT l_orderkey, l_partkey, sum(1 + CAST(l_quantity AS BIGINT) % 3) AS span FROM lineitem GROUP BY 1, 2"


def _cells(lineitem):
    return lineitem.groupBy("l_orderkey", "l_partkey").agg(F.sum(1 + F.col("l_quantity").cast("long") % 3).alias("span"))


@query("grid_columns", f"SELECT l_orderkey, l_partkey, CAST(span AS BIGINT) AS span, CAST(sum(span) OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - span AS BIGINT) AS grid_column FROM ({_CELLS})", "lineitem")
def _(lineitem):
    return tables.grid_columns(_cells(lineitem), "l_orderkey", "l_partkey", "span")


@query("table_width", f"SELECT l_orderkey, CAST(sum(span) AS BIGINT) AS width, count(*) AS cells FROM ({_CELLS}) GROUP BY 1", "lineitem")
def _(lineitem):
    return tables.widths(_cells(lineitem), "l_orderkey", "span")


# findings


@query("baseline_diff", "WITH ran AS (SELECT doc_id FROM labels WHERE toxic = 0 OR quality = 0), a AS (SELECT doc_id FROM labels WHERE quality = 0), b AS (SELECT doc_id FROM labels WHERE (toxic = 1 OR doc_id % 3 = 0) AND doc_id IN (SELECT doc_id FROM ran)) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'new' WHEN a.doc_id IS NULL THEN 'fixed' ELSE 'known' END AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id", "labels")
def _(labels):
    return findings.diff(labels.where("quality = 0").select("doc_id"), labels.where("toxic = 1 OR doc_id % 3 = 0").select("doc_id"), labels.where("toxic = 0 OR quality = 0"), "doc_id")


@query("matrix_margins", "SELECT lang, source, count(*) AS n, CAST(sum(CAST(quality = 0 AS INTEGER)) AS BIGINT) AS failed FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())", "labels", "documents")
def _(labels, documents):
    rows = labels.join(documents.select("doc_id", "lang", "source"), "doc_id").withColumn("bad", F.col("quality") == 0)
    return findings.margins(rows, "lang", "source", "bad")


#: A cell (lang, source) fails the same way, its family, if it has a larger share of such documents than allowed in 100.
FAILS = {"quality": ("quality = 0", 20), "toxic": ("toxic = 1", 5)}
CELLS = "d AS (SELECT lang, source, quality, toxic FROM labels JOIN documents USING (doc_id)), cells AS (SELECT DISTINCT lang, source FROM d), failing AS (" + " UNION ALL ".join(f"SELECT lang, source, '{k}' AS family FROM d GROUP BY 1, 2 HAVING 100 * sum(CAST({c} AS INTEGER)) > {p} * count(*)" for k, (c, p) in FAILS.items()) + ")"
BROKEN = " UNION ALL ".join(f"SELECT '{c}' AS kind, f.{c} AS name, family, count(*) AS failing, any_value(t.n) AS cells FROM failing f JOIN (SELECT {c}, count(*) AS n FROM cells GROUP BY 1) t ON f.{c} = t.{c} GROUP BY 1, 2, 3 HAVING count(*) > 1 AND count(*) >= 0.6 * any_value(t.n)" for c in ("lang", "source"))


def matrix_cells(labels, documents):
    """All cells, and those that fail with the family of the failure."""
    rows = labels.join(documents.select("doc_id", "lang", "source"), "doc_id")
    parts = [rows.groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_if(F.expr(c)).alias("bad")).where(F.expr(f"100 * bad > {p} * n")).select("lang", "source", F.lit(k).alias("family")) for k, (c, p) in FAILS.items()]
    return rows.select("lang", "source").distinct(), parts[0].unionByName(parts[1])


@query("broken_rows", f"WITH {CELLS} {BROKEN}", "labels", "documents")
def _(labels, documents):
    cells, failing = matrix_cells(labels, documents)
    lines = [findings.broken_lines(cells, failing, c, "family").select(F.lit(c).alias("kind"), F.col(c).alias("name"), "family", "failing", "cells") for c in ("lang", "source")]
    return lines[0].unionByName(lines[1])


@query("cross_compatible", "SELECT s_suppkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON r_regionkey <> n_regionkey AND s_suppkey % 2 = r_regionkey % 2", "supplier", "nation", "region")
def _(supplier, nation, region):
    placed = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("parity", F.col("s_suppkey") % 2)
    return placed.join(region.withColumn("parity", F.col("r_regionkey") % 2), "parity").where("r_regionkey <> n_regionkey").select("s_suppkey", "r_name")
