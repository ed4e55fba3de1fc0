"""Queries for counters, labels, scopes, nesting, citations, slides and result tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import typeset as T
from scriptorium.operators import citations, scopes
from scriptorium.plans.queries import query
from scriptorium.sources import bibtex

_USER = (["user_id"], ["ts", "event_id"])
_W = "(PARTITION BY user_id ORDER BY ts, event_id)"


@query("user_counters", f"SELECT event_id, CAST(sum(CASE event_type WHEN 'purchase' THEN floor(value) WHEN 'click' THEN 1 WHEN 'view' THEN event_id % 5 ELSE 0 END) OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id) AS BIGINT) AS counter FROM (SELECT *, sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) OVER {_W} AS epoch FROM events)", "events")
def _(events):
    kind = F.col("event_type")
    change = F.when(kind == "purchase", F.floor("value")).when(kind == "click", 1).when(kind == "view", F.col("event_id") % 5)
    return scopes.user_counter(events, *_USER, kind.isin("purchase", "signup"), change).select("event_id", F.col("counter").cast("long").alias("counter"))


@query("label_targets", f"SELECT event_id, target, target IS NOT NULL AND row_number() OVER (PARTITION BY user_id, target ORDER BY ts, event_id) > 1 AS alias FROM (SELECT *, last_value(CASE WHEN event_type IN ('purchase', 'signup') THEN event_id END IGNORE NULLS) OVER {_W} AS target FROM events) WHERE event_type = 'click'", "events")
def _(events):
    kind = F.col("event_type")
    return scopes.label_targets(events, *_USER, kind == "click", F.when(kind.isin("purchase", "signup"), F.col("event_id"))).select("event_id", "target", "alias")


@query("declaration_scope", "SELECT conv_id, turn, last_value(CASE WHEN length(text) % 5 = 0 THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id, role ORDER BY turn) AS size FROM conversations", "conversations")
def _(conversations):
    size = F.length("text").cast("long")
    return scopes.in_force(conversations, ["conv_id", "role"], ["turn"], F.when(size % 5 == 0, size), "size").select("conv_id", "turn", "size")


@query("list_parents", "WITH c AS (SELECT conv_id, turn, length(text) % 4 AS level FROM conversations) SELECT a.conv_id, a.turn, max(b.turn) AS parent FROM c a LEFT JOIN c b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.level < a.level GROUP BY 1, 2", "conversations")
def _(conversations):
    rows = conversations.withColumn("level", F.length("text") % 4)
    return scopes.list_parents(rows, ["conv_id"], "turn", "level").select("conv_id", "turn", "parent")


@query("field_phases", f"SELECT event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER {_W} AS BIGINT) AS field, CASE WHEN open IS NULL OR (ended IS NOT NULL AND ended > open) THEN 'outside' WHEN parted IS NOT NULL AND parted > open THEN 'result' ELSE 'instr' END AS phase FROM (SELECT *, max(CASE WHEN event_type = 'signup' THEN n END) OVER {_W} AS open, max(CASE WHEN event_type = 'purchase' THEN n END) OVER {_W} AS parted, max(CASE WHEN event_type = 'error' THEN n END) OVER {_W} AS ended FROM (SELECT *, row_number() OVER {_W} AS n FROM events))", "events")
def _(events):
    kind = F.col("event_type")
    return scopes.field_phases(events, *_USER, kind == "signup", kind == "purchase", kind == "error").select("event_id", "field", "phase")


@query("algorithm_indent", f"SELECT event_id, CAST(s - least(0, min(s) OVER {_W}) AS BIGINT) AS indent, CASE WHEN n % 5 = 0 THEN n END AS shown FROM (SELECT *, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER {_W} AS s, row_number() OVER {_W} AS n FROM events)", "events")
def _(events):
    change = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    from scriptorium.operators import numbering

    lines = numbering.counter(scopes.indents(events, *_USER, change), *_USER)
    return lines.select("event_id", F.col("indent").cast("long").alias("indent"), F.when(F.col("number") % 5 == 0, F.col("number").cast("long")).alias("shown"))


@query("marked_segments", f"SELECT event_id, CAST(segment AS BIGINT) AS segment FROM (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER {_W} AS segment FROM events) WHERE event_type <> 'error'", "events")
def _(events):
    return scopes.segments(events, *_USER, F.col("event_type") == "error").select("event_id", "segment")


_PART = "CASE CAST(l_quantity AS INT) % 9 WHEN 0 THEN 'firsthead' WHEN 1 THEN 'head' WHEN 2 THEN 'foot' WHEN 3 THEN 'lastfoot' END"


@query("long_tables", f"WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, {_PART} AS mark, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem), p AS (SELECT a.*, (SELECT min(b.n) FROM m b WHERE b.l_orderkey = a.l_orderkey AND b.mark IS NOT NULL AND b.n >= a.n) AS ends FROM m a), h AS (SELECT l_orderkey, coalesce(max(n) FILTER (mark = 'head'), max(n) FILTER (mark = 'firsthead')) AS head FROM m GROUP BY 1) SELECT p.l_orderkey, p.l_linenumber, p.l_partkey, coalesce((SELECT mark FROM m WHERE m.l_orderkey = p.l_orderkey AND m.n = p.ends), 'body') AS part FROM p JOIN h USING (l_orderkey) WHERE ends IS NULL OR ends = head", "lineitem")
def _(lineitem):
    out = scopes.long_table(lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], F.expr(_PART))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "part")


@query("partial_rules", "SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber BETWEEN 1 + l_orderkey % 3 AND 3 + l_orderkey % 2 AS ruled FROM lineitem", "lineitem")
def _(lineitem):
    return scopes.cells_under_rule(lineitem, "l_linenumber", 1 + F.col("l_orderkey") % 3, 3 + F.col("l_orderkey") % 2).select("l_orderkey", "l_linenumber", "l_partkey", "ruled")


_ENTRIES = "SELECT l_orderkey, l_suppkey AS key, min(l_linenumber) AS cited, any_value(s_name) AS author, min(strftime(l_shipdate, '%Y')) AS year, CASE WHEN l_orderkey % 3 = 0 AND l_suppkey % 2 = 0 THEN l_suppkey END AS given FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"


def _entries(lineitem, supplier):
    both = lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("key", F.col("l_suppkey"))
    entries = both.groupBy("l_orderkey", "key").agg(F.min("l_linenumber").alias("cited"), F.first("s_name").alias("author"), F.min(F.date_format("l_shipdate", "yyyy")).alias("year"))
    return entries.withColumn("given", F.when((F.col("l_orderkey") % 3 == 0) & (F.col("key") % 2 == 0), F.col("key")))


for _numeric, _order in ((True, "cited"), (False, "lower(author), year, cited")):
    _name = "bibliography_numeric" if _numeric else "bibliography_by_author"
    _SQL = f"WITH e AS ({_ENTRIES}), h AS (SELECT *, bool_or(given IS NOT NULL) OVER (PARTITION BY l_orderkey) AS has FROM e) SELECT l_orderkey, key, row_number() OVER (PARTITION BY l_orderkey, has ORDER BY coalesce(given, 1073741824), cited, key) AS number FROM h WHERE has UNION ALL SELECT l_orderkey, key, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_order}, key) FROM h WHERE NOT has"

    @query(_name, _SQL, "lineitem", "supplier")
    def _(lineitem, supplier, numeric=_numeric):
        return citations.bibliography_order(_entries(lineitem, supplier), ["l_orderkey"], numeric).select("l_orderkey", "key", "number")


@query("cite_strings", "SELECT l_orderkey, '[' || string_agg(coalesce(s_name, CAST(l_suppkey AS VARCHAR)), ', ' ORDER BY l_linenumber, coalesce(s_name, CAST(l_suppkey AS VARCHAR))) || ']' AS cited FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal >= 0) ON l_suppkey = s_suppkey GROUP BY 1", "lineitem", "supplier")
def _(lineitem, supplier):
    items = supplier.where("s_acctbal >= 0").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("label"))
    return citations.cite_strings(lineitem.withColumn("key", F.col("l_suppkey")), items, ["l_orderkey"], "l_linenumber")


@query("bookmark_fields", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN coalesce(CAST(page AS VARCHAR), '1') WHEN 'O' THEN coalesce(rtrim(number, '.'), o_orderpriority) ELSE CASE WHEN trim(coalesce(words, '')) = '' THEN o_orderpriority ELSE trim(words) END END AS result FROM orders LEFT JOIN (SELECT c_custkey, c_custkey % 97 AS page, c_nationkey || repeat('.', c_custkey % 3) AS number, CASE WHEN c_nationkey < 9 THEN '  ' ELSE ' ' || c_name END AS words FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey", "orders", "customer")
def _(orders, customer):
    """Fields that ask for a bookmark's page, number or text, by the status of an order; what they showed was its priority."""
    words = F.when(F.col("c_nationkey") < 9, "  ").otherwise(F.concat(F.lit(" "), "c_name"))
    number = F.concat(F.col("c_nationkey").cast("string"), F.expr("repeat('.', CAST(c_custkey % 3 AS INT))"))
    marks = customer.where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 97).alias("page"), number.alias("number"), words.alias("words"))
    kind = F.when(F.col("o_orderstatus") == "F", "page").when(F.col("o_orderstatus") == "O", "number").otherwise("text")
    return orders.join(marks, "o_custkey", "left").select("o_orderkey", scopes.field_text(kind, F.col("o_orderpriority"), F.col("page"), F.col("number"), F.col("words")).alias("result"))


@query("colour_lookup", "WITH d AS (SELECT lower(p_brand) AS name, arg_max(upper(printf('%06x', CAST(p_partkey AS INTEGER))), p_partkey) AS rgb FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN rgb IS NOT NULL THEN rgb WHEN regexp_full_match(spec, '#?[0-9A-Fa-f]{6}') THEN upper(ltrim(spec, '#')) END AS rgb FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN '#' || lpad(CAST(p_partkey % 1000000 AS VARCHAR), 6, 'a') ELSE p_type END AS spec FROM part) LEFT JOIN d ON lower(spec) = name", "part")
def _(part):
    """Names in any case, of which the last definition holds; six hexadecimal digits stand for themselves."""
    hexed = F.lpad(F.hex("p_partkey"), 6, "0")
    named = part.groupBy(F.lower("p_brand").alias("name")).agg(F.max_by(hexed, "p_partkey").alias("rgb"))
    key = F.col("p_partkey")
    spec = F.when(key % 3 == 0, F.upper("p_brand")).when(key % 3 == 1, F.concat(F.lit("#"), F.lpad((key % 1000000).cast("string"), 6, "a"))).otherwise(F.col("p_type"))
    found = part.select("p_partkey", spec.alias("spec")).join(named, F.lower("spec") == F.col("name"), "left")
    literal = F.when(F.col("spec").rlike("^#?[0-9A-Fa-f]{6}$"), F.upper(F.ltrim("spec", F.lit("#"))))
    return found.select("p_partkey", F.coalesce("rgb", literal).alias("rgb"))


@query("style_family", "SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 2) THEN 'author-year' ELSE 'numeric' END AS family FROM part", "part")
def _(part):
    styles = F.array(*map(F.lit, [" PlainNat ", "unsrt", "apa", "unknown"]))
    return part.select("p_partkey", T.style_family(F.get(styles, (F.col("p_partkey") % 4).cast("int"))).alias("family"))


@query("changed_case", "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN text ELSE upper(replace(text, 'ß', 'SS')) END AS upper_text, CASE WHEN role = 'assistant' THEN text ELSE lower(text) END AS lower_text FROM conversations", "conversations")
def _(conversations):
    kind = F.when(F.col("role") == "assistant", "math").otherwise("text")
    return conversations.select("conv_id", "turn", T.changed_case(F.col("text"), kind, True).alias("upper_text"), T.changed_case(F.col("text"), kind, False).alias("lower_text"))


@query("first_upper", "SELECT p_partkey, upper(p_name[1]) || p_name[2:] AS name FROM part", "part")
def _(part):
    return part.select("p_partkey", T.first_upper(F.col("p_name")).alias("name"))


_SOURCE = "'\\documentclass[a4paper, ' || CASE WHEN o_custkey % 3 = 0 THEN 'twocolumn' ELSE 'onecolumn' END || ']{article} x\\pause y\\onslide [2] z\\pausex \\begin{multicols}{' || o_custkey % 4 || '}'"


@query("page_columns", "SELECT o_orderkey, CAST(greatest(CASE WHEN o_custkey % 3 = 0 THEN 2 ELSE 1 END, o_custkey % 4) AS INTEGER) AS columns FROM orders", "orders")
def _(orders):
    return orders.select("o_orderkey", T.page_columns(F.expr(_SOURCE.replace("\\", "\\\\"))).alias("columns"))


@query("without_pauses", "SELECT o_orderkey, replace(replace(" + _SOURCE + ", '\\pause y', ' y'), '\\onslide [2]', '') AS source FROM orders", "orders")
def _(orders):
    return orders.select("o_orderkey", T.without_pauses(F.expr(_SOURCE.replace("\\", "\\\\"))).alias("source"))


@query("long_dates", "SELECT o_orderkey, strftime(o_orderdate, '%B %-d, %Y') AS day FROM orders", "orders")
def _(orders):
    return orders.select("o_orderkey", T.long_date(F.col("o_orderdate")).alias("day"))


@query("cjk_runs", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN true ELSE coalesce(regexp_matches(html, '[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}\\x{ac00}-\\x{d7af}\\x{ff00}-\\x{ffef}]'), false) END AS cjk FROM pages", "pages")
def _(pages):
    return pages.select("page_id", T.has_cjk(F.when(F.col("page_id") % 3 == 0, F.concat(F.coalesce("html", F.lit("")), F.lit("漢字"))).otherwise(F.col("html"))).alias("cjk"))


# results


@query("areas", "SELECT coalesce(source, '') AS area, count(*) AS probes, count(*) FILTER (WHERE quality = 0) AS failing FROM labels JOIN documents USING (doc_id) GROUP BY 1", "labels", "documents")
def _(labels, documents):
    """Probes and failures of each area, the part of an id before its slash."""
    ids = documents.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("")), F.col("doc_id").cast("string")).alias("id"))
    area = F.split_part("id", F.lit("/"), F.lit(1))
    return labels.join(ids, "doc_id").groupBy(area.alias("area")).agg(F.count("*").alias("probes"), F.count_if(F.col("quality") == 0).alias("failing"))


@query("probe_signatures", "SELECT user_id, array_to_string(list(DISTINCT event_type ORDER BY event_type), ',') AS signatures FROM events GROUP BY 1", "events")
def _(events):
    return events.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("signatures"))


@query("triage_order", "SELECT event_type, n, row_number() OVER (ORDER BY n DESC, event_type) AS place FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)", "events")
def _(events):
    """Kinds of failure by how often they occur, then by name; a row for each kind."""
    from pyspark.sql import Window

    return events.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "event_type")))


@query("longest_first", "SELECT conv_id, array_to_string(list(DISTINCT w ORDER BY length(w) DESC, w), ' ') AS words FROM (SELECT conv_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM conversations) GROUP BY 1", "conversations")
def _(conversations):
    """Names as alternatives of a pattern: none stands before a longer one that it begins."""
    names = conversations.select("conv_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("w")).distinct()
    parts = names.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct((-F.length("w")).alias("n"), "w"))).alias("p"))
    return parts.select("conv_id", F.array_join(F.transform("p", lambda x: x["w"]), " ").alias("words"))


@query("orphan_ids", "SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500 AND doc_id IS NOT NULL)", "labels", "documents")
def _(labels, documents):
    return labels.select("doc_id").distinct().join(documents.where("n_chars > 500").select("doc_id"), "doc_id", "left_anti")


@query("meta_fill", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, c_mktsegment) AS title, coalesce(CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END, c_name) AS author FROM orders LEFT JOIN customer ON o_custkey = c_custkey", "orders", "customer")
def _(orders, customer):
    """Each field of the body, or of the preamble where the body has none."""
    body = orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("title"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string")).alias("author"))
    preamble = customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_name")
    return body.join(preamble, "o_custkey", "left").select("o_orderkey", F.coalesce("title", "c_mktsegment").alias("title"), F.coalesce("author", "c_name").alias("author"))


@query("unique_cases", "SELECT event_type, props, min(event_id) AS event_id FROM events GROUP BY 1, 2", "events")
def _(events):
    return events.groupBy("event_type", "props").agg(F.min("event_id").alias("event_id"))


@query("concatenated", "SELECT conv_id, turn - 100000 AS place, text FROM conversations WHERE turn = 0 UNION ALL SELECT conv_id, turn, text FROM conversations", "conversations")
def _(conversations):
    """A teaser before all blocks, in one order of places."""
    rows = conversations.select("conv_id", F.col("turn").alias("place"), "text")
    return rows.where("place = 0").withColumn("place", F.col("place") - 100000).unionByName(rows)


@query("distinct_paths", "SELECT page_id, array_to_string(list(p ORDER BY i), ':') AS paths FROM (SELECT page_id, p, min(i) AS i FROM (SELECT page_id, unnest(string_split(regexp_replace(url, '/+', '/', 'g'), '/')) AS p, generate_subscripts(string_split(regexp_replace(url, '/+', '/', 'g'), '/'), 1) AS i FROM pages) GROUP BY 1, 2) GROUP BY 1", "pages")
def _(pages):
    """The distinct parts of a path without empty ones inside, in first-seen order."""
    parts = F.array_distinct(F.split(F.regexp_replace("url", "/+", "/"), "/", -1))
    return pages.where("url IS NOT NULL").select("page_id", F.array_join(parts, ":").alias("paths"))


@query("enum_check", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view', 'signup')", "events")
def _(events):
    return events.where(~F.col("event_type").isin("click", "view", "signup")).select("event_id", "event_type")


@query("accepted_changes", "SELECT user_id, string_agg(event_type, ' ' ORDER BY ts, event_id) AS kept FROM events WHERE event_type NOT IN ('error', 'purchase') GROUP BY 1", "events")
def _(events):
    """Runs of a paragraph with all tracked changes accepted: what was deleted or moved away goes (here errors and purchases)."""
    kept = events.where(~F.col("event_type").isin("error", "purchase")).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("r"))
    return kept.select("user_id", F.array_join(F.transform("r", lambda x: x["event_type"]), " ").alias("kept"))


@query("note_ids", "SELECT page_id, note, CAST(row_number() OVER (PARTITION BY page_id ORDER BY note) AS INTEGER) AS id FROM (SELECT page_id, unnest(range(len(regexp_extract_all(html, '<a[ >]')))) AS note FROM pages)", "pages")
def _(pages):
    """Notes of a page get ids from 1 in their order; -1 and 0 are the separators'."""
    from scriptorium.operators import numbering

    notes = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<a[ >]"), 0)).alias("note", "m"))
    return numbering.counter(notes, ["page_id"], ["note"]).select("page_id", F.col("note").cast("long").alias("note"), F.col("number").cast("int").alias("id"))


@query("bibtex_fields", "SELECT o_custkey, o_orderkey AS key, unnest(['title', 'year', 'publisher']) AS name, unnest(['On {{' || o_orderpriority || '}, one}', strftime(o_orderdate, '%Y'), CASE WHEN o_orderstatus = 'F' THEN 'The {Press}, Ltd' ELSE o_orderstatus END]) AS value FROM orders", "orders")
def _(orders):
    """A BibTeX file for each customer, with an entry for each order and a string, read again."""
    entry = F.concat(F.lit("\n@book{"), F.col("o_orderkey").cast("string"), F.lit(', title = "On {{'), F.col("o_orderpriority"), F.lit('}, one}", year = '), F.date_format("o_orderdate", "yyyy"), F.lit(", Publisher = "), F.when(F.col("o_orderstatus") == "F", "PRESS").otherwise(F.concat(F.lit("{"), F.col("o_orderstatus"), F.lit("}"))), F.lit("}"))
    files = orders.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list(entry)), "\n").alias("entries"))
    files = files.select("o_custkey", F.concat(F.lit("@string{press = {The {Press}, Ltd}} "), F.col("entries")).alias("text"))
    return bibtex.fields(files, "o_custkey").select(F.col("path").alias("o_custkey"), F.col("key").cast("long").alias("key"), "name", "value")
