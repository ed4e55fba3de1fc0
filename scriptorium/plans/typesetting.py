"""Queries for numerals, names, colours, lengths, scopes, captions and chains, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.functions import typeset as T
from scriptorium.operators import findings, numbering, reconcile, structure
from scriptorium.plans.queries import BROKEN, CELLS, matrix_cells, query

_LETTERS = "CASE WHEN {n} <= 26 THEN chr(CAST(96 + {n} AS INTEGER)) WHEN {n} <= 702 THEN chr(CAST(96 + ({n} - 1) // 26 AS INTEGER)) || chr(CAST(97 + ({n} - 1) % 26 AS INTEGER)) ELSE chr(CAST(97 + ({n} - 703) // 676 AS INTEGER)) || chr(CAST(97 + (({n} - 703) // 26) % 26 AS INTEGER)) || chr(CAST(97 + ({n} - 703) % 26 AS INTEGER)) END"
_BY_USER = "PARTITION BY user_id ORDER BY ts, event_id"


# numerals, lists, names


@query("letter_numerals", f"SELECT p_partkey, {_LETTERS.format(n='k')} AS letters FROM (SELECT p_partkey, 1 + p_partkey % 18000 AS k FROM part)", "part")
def _(part):
    return part.select("p_partkey", T.letters(1 + F.col("p_partkey") % 18000).alias("letters"))


@query("footnote_marks", "SELECT p_partkey, CASE WHEN p_size <= 8 THEN ['*', '†', '‡', '§', '¶', '‖', '**', '††'][p_size] ELSE CAST(p_size AS VARCHAR) END AS mark FROM part", "part")
def _(part):
    return part.select("p_partkey", T.footnote_mark(F.col("p_size")).alias("mark"))


@query("angles", "SELECT o_orderkey, (o_orderkey % 360) || '°' || CASE WHEN o_custkey % 60 = 0 THEN '' ELSE (o_custkey % 60) || '′' END || CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE (o_orderkey % 6) || '″' END AS angle FROM orders", "orders")
def _(orders):
    return orders.select("o_orderkey", T.angle(F.concat_ws(";", F.col("o_orderkey") % 360, F.col("o_custkey") % 60, F.col("o_orderkey") % 6)).alias("angle"))


@query("number_lists", "SELECT l_orderkey, CASE WHEN len(n) = 1 THEN n[1] ELSE array_to_string(n[1:len(n) - 1], ', ') || ' and ' || n[len(n)] END AS parts FROM (SELECT l_orderkey, list(CAST(l_partkey AS VARCHAR) ORDER BY l_partkey) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1)", "lineitem")
def _(lineitem):
    parts = lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("n"))
    return parts.select("l_orderkey", T.listed(F.transform("n", lambda x: x.cast("string"))).alias("parts"))


@query("author_label", "SELECT o_orderkey, CASE WHEN a IS NULL THEN CAST(o_orderkey AS VARCHAR) WHEN len(a) = 1 THEN a[1] WHEN len(a) = 2 THEN a[1] || ' & ' || a[2] ELSE a[1] || ' et al.' END AS label FROM orders LEFT JOIN (SELECT l_orderkey, list(DISTINCT s_name ORDER BY s_name) AS a FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) ON l_orderkey = o_orderkey", "orders", "lineitem", "supplier")
def _(orders, lineitem, supplier):
    names = lineitem.join(supplier, lineitem.l_suppkey == supplier.s_suppkey).groupBy("l_orderkey").agg(F.sort_array(F.collect_set("s_name")).alias("a"))
    both = orders.join(names, orders.o_orderkey == names.l_orderkey, "left")
    return both.select("o_orderkey", T.author_label(F.coalesce("a", F.array().cast("array<string>")), F.col("o_orderkey").cast("string")).alias("label"))


@query("years", "SELECT doc_id, CASE WHEN regexp_extract(text, '[0-9]{4}') = '' THEN 'n.d.' ELSE regexp_extract(text, '[0-9]{4}') END AS year FROM documents WHERE text IS NOT NULL", "documents")
def _(documents):
    return documents.where("text IS NOT NULL").select("doc_id", T.year(F.col("text")).alias("year"))


@query("sub_letters", f"SELECT o_orderkey, {_LETTERS.format(n='k')} AS letter FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)", "orders")
def _(orders):
    return numbering.counter(orders, ["o_custkey"], ["o_orderkey"]).select("o_orderkey", T.letters(F.col("number")).alias("letter"))


@query("panel_labels", "SELECT n_name AS key, r_name AS kept, chr(CAST(96 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER)) AS sub FROM nation JOIN region ON n_regionkey = r_regionkey", "nation", "region")
def _(nation, region):
    panels = numbering.counter(nation, ["n_regionkey"], ["n_nationkey"])
    return panels.join(region, panels.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("key"), F.col("r_name").alias("kept"), T.letters(F.col("number")).alias("sub"))


# texts


@query("prose_key", "SELECT doc_id, md5(lower(regexp_replace(text, '[ \\t\\n\\r{}:_]+', '', 'g'))) AS text_md5 FROM documents", "documents")
def _(documents):
    return documents.select("doc_id", F.md5(F.encode(T.prose_key(F.col("text")), "utf-8")).alias("text_md5"))


@query("clean_inlines", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' ([,.;:!?)\\]}])', '\\1', 'g'), ' ')) AS text_md5 FROM documents", "documents")
def _(documents):
    return documents.select("doc_id", F.md5(F.encode(T.tidy(F.col("text")), "utf-8")).alias("text_md5"))


@query("control_characters", "SELECT doc_id, md5(regexp_replace(replace(text, chr(12), chr(10) || chr(10)), '[\\x01-\\x08\\x0B\\x0E-\\x1F]', '', 'g')) AS text_md5 FROM documents", "documents")
def _(documents):
    return documents.select("doc_id", F.md5(F.encode(T.scrubbed(F.col("text")), "utf-8")).alias("text_md5"))


#: Tokens that a text should hold once.
TOKENS = ["license", "http", "@", "%", "$"]
_COUNTED = f"SELECT doc_id, token, CAST((length(text) - length(replace(text, token, ''))) // length(token) AS BIGINT) AS n FROM (SELECT doc_id, text, unnest({TOKENS}) AS token FROM documents WHERE text IS NOT NULL)"


def _counted(documents):
    rows = documents.where("text IS NOT NULL").select("doc_id", "text", F.explode(F.array(*map(F.lit, TOKENS))).alias("token"))
    return rows.select("doc_id", "token", T.occurrences(F.col("text"), F.col("token")).alias("n"))


@query("token_counts", f"SELECT * FROM ({_COUNTED}) WHERE n > 0", "documents")
def _(documents):
    return _counted(documents).where("n > 0")


@query("dropped_duplicated", f"SELECT token, CASE WHEN n = 0 THEN 'dropped' ELSE 'duplicated' END AS finding, count(*) AS documents, CAST(sum(n) AS BIGINT) AS found FROM ({_COUNTED}) WHERE n <> 1 GROUP BY 1, 2", "documents")
def _(documents):
    rows = _counted(documents).where("n <> 1").withColumn("finding", F.when(F.col("n") == 0, "dropped").otherwise("duplicated"))
    return rows.groupBy("token", "finding").agg(F.count("*").alias("documents"), F.sum("n").alias("found"))


# colours and lengths


_HEX = "lpad(upper(to_hex(CAST(round_even({}, 0) AS BIGINT))), 2, '0')"


@query("colour_models", "SELECT p_partkey, repeat(" + _HEX.format("p_size * 255 / 100.0") + ", 3) AS grey, " + " || ".join(_HEX.format(f"((100 - (p_partkey * {k}) % 101) * (100 - p_size) * 255) / 10000.0") for k in (1, 3, 7)) + " AS ink FROM part", "part")
def _(part):
    inks = [F.col("p_partkey") * k % 101 for k in (1, 3, 7)]
    return part.select("p_partkey", T.grey(F.col("p_size")).alias("grey"), T.cmyk(*inks, F.col("p_size")).alias("ink"))


@query("lengths", "SELECT p_partkey, CAST(floor(p_size * (914400 / CAST(72.27 AS DOUBLE))) AS BIGINT) AS points, CAST(floor(p_size * (914400 / CAST(2.54 AS DOUBLE)) / 635) AS BIGINT) AS twips_of_centimetres, ((360 - p_partkey % 360) % 360) * 60000 AS rotation FROM part", "part")
def _(part):
    size = F.col("p_size")
    return part.select("p_partkey", F.floor(X.to_emu(size, "pt")).alias("points"), F.floor(X.to_emu(size, "cm") / 635).alias("twips_of_centimetres"), T.rotation(F.col("p_partkey") % 360).alias("rotation"))


@query("image_extent", "SELECT p_partkey, CASE WHEN w > 5943600 THEN 5943600 ELSE w END AS width, CASE WHEN w > 5943600 THEN CAST(floor(CAST(h * 5943600 AS DOUBLE) / w) AS BIGINT) ELSE h END AS height FROM (SELECT p_partkey, CAST(p_size AS BIGINT) * 360000 AS w, (1 + p_partkey % 40) * 360000 AS h FROM part)", "part")
def _(part):
    width, height = T.fitted(F.col("p_size").cast("long") * 360000, (1 + F.col("p_partkey") % 40) * 360000, 5943600)
    return part.select("p_partkey", width.alias("width"), height.alias("height"))


# scopes, regions, captions


@query("appendix_epoch", f"SELECT event_id, coalesce(bool_or(event_type = 'signup') OVER ({_BY_USER}), false) AS after FROM events", "events")
def _(events):
    return structure.epoch(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup").select("event_id", "after")


@query("page_estimate", f"SELECT event_id, 1 + count(*) FILTER (event_type = 'signup') OVER ({_BY_USER}) AS page FROM events", "events")
def _(events):
    return structure.pages(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup").select("event_id", "page")


@query("line_tags", f"SELECT event_id, CASE WHEN event_type = 'click' THEN 'C' || event_id ELSE CAST(count(*) FILTER (event_type <> 'click') OVER ({_BY_USER}) AS VARCHAR) END AS number FROM events", "events")
def _(events):
    tag = F.when(F.col("event_type") == "click", F.concat(F.lit("C"), F.col("event_id")))
    return structure.tagged(events, ["user_id"], ["ts", "event_id"], tag).select("event_id", "number")


@query("header_rows", f"WITH n AS (SELECT *, row_number() OVER ({_BY_USER}) AS k FROM events) SELECT event_id FROM (SELECT *, min(CASE WHEN event_type = 'click' THEN k END) OVER (PARTITION BY user_id) AS first FROM n) WHERE k < first", "events")
def _(events):
    return structure.before_first(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click").select("event_id")


@query("bookmark_contents", f"WITH o AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER ({_BY_USER}) AS region FROM events), c AS (SELECT *, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id, region ORDER BY ts, event_id) AS shut FROM o) SELECT user_id, region, count(*) AS n, min(event_id) AS least, max(event_id) AS most FROM c WHERE region > 0 AND shut = 0 AND event_type <> 'signup' GROUP BY 1, 2", "events")
def _(events):
    inside = structure.enclosed(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "click")
    return inside.groupBy("user_id", "region").agg(F.count("*").alias("n"), F.min("event_id").alias("least"), F.max("event_id").alias("most"))


@query("caption_attach", "SELECT conv_id, before AS target, turn AS caption FROM (SELECT *, lag(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL AND role = 'assistant'", "conversations")
def _(conversations):
    return structure.captions(conversations, ["conv_id"], "turn", F.col("role") == "user", F.col("role") == "assistant")


@query("named_ref_groups", "WITH m AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS new FROM conversations)) SELECT conv_id, CAST(run AS BIGINT) AS run, any_value(role) || CASE WHEN count(*) > 1 THEN 's' ELSE '' END AS name, count(*) AS n FROM m GROUP BY 1, 2", "conversations")
def _(conversations):
    groups = numbering.runs(conversations, ["conv_id"], ["turn"], "role")
    return groups.select("conv_id", "run", F.concat("role", F.when(F.col("length") > 1, "s").otherwise("")).alias("name"), F.col("length").alias("n"))


# joins and sets


@query("multi_key_refs", "SELECT l_orderkey, count(*) AS keys, count(p_partkey) AS found, count(*) - count(p_partkey) AS dangling FROM (SELECT l_orderkey, unnest([l_partkey, l_suppkey]) AS key FROM lineitem) LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 25) ON key = p_partkey GROUP BY 1", "lineitem", "part")
def _(lineitem, part):
    refs = lineitem.select("l_orderkey", F.explode(F.array("l_partkey", "l_suppkey")).alias("key"))
    both = refs.join(part.where("p_size > 25").select("p_partkey"), F.col("key") == F.col("p_partkey"), "left")
    counts = both.groupBy("l_orderkey").agg(F.count("*").alias("keys"), F.count("p_partkey").alias("found"))
    return counts.withColumn("dangling", F.col("keys") - F.col("found"))


@query("shared_counters", "WITH RECURSIVE up AS (SELECT c_custkey AS key, c_custkey - 7 AS kept FROM customer WHERE c_custkey % 100 >= 7 UNION ALL SELECT key, kept - 7 FROM up WHERE kept % 100 >= 7) SELECT key, min(kept) AS root FROM up GROUP BY 1", "customer")
def _(customer):
    links = customer.where("c_custkey % 100 >= 7").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") - 7).alias("kept"))
    return structure.chain_ends(links, "key", "kept").withColumnRenamed("kept", "root")


@query("overlay_precedence", "SELECT nation, prio, n FROM (SELECT c_nationkey AS nation, 1 AS prio, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1 UNION ALL SELECT s_nationkey, 0, count(*) FROM supplier WHERE s_acctbal < 0 GROUP BY 1) QUALIFY row_number() OVER (PARTITION BY nation ORDER BY prio) = 1", "customer", "supplier")
def _(customer, supplier):
    of = lambda df, c, bal, prio: df.where(F.col(bal) < 0).groupBy(F.col(c).alias("nation")).agg(F.count("*").alias("n")).withColumn("prio", F.lit(prio))
    return structure.by_precedence(of(customer, "c_nationkey", "c_acctbal", 1).unionByName(of(supplier, "s_nationkey", "s_acctbal", 0)), "nation", "prio").select("nation", "prio", "n")


@query("interactions", f"WITH {CELLS}, broken AS ({BROKEN}) SELECT lang, source, family FROM failing f WHERE NOT EXISTS (SELECT 1 FROM broken b WHERE b.family = f.family AND (b.kind = 'lang' AND b.name = f.lang OR b.kind = 'source' AND b.name = f.source))", "labels", "documents")
def _(labels, documents):
    cells, failing = matrix_cells(labels, documents)
    return structure.explained_apart(cells, failing, "lang", "source", "family").select("lang", "source", "family")


@query("signature_families", "SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE event_type || ':' || user_id % 10 END AS family, count(*) AS n FROM events GROUP BY 1", "events")
def _(events):
    signature = F.concat_ws(":", "event_type", F.col("user_id") % 10)
    family = F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise(signature)
    return events.groupBy(family.alias("family")).agg(F.count("*").alias("n"))


#: What was found now, what was on file, the probes that ran and those that there are: users, whose kinds of event stand for failures.
_RUN = "ran AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), a AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 40 AND user_id IN (SELECT user_id FROM ran)), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), every AS (SELECT DISTINCT user_id FROM events WHERE event_type IN ('purchase', 'signup'))"


def _run(events):
    users = lambda *kinds: events.where(F.col("event_type").isin(*kinds)).select("user_id").distinct()
    pairs = lambda rows: rows.select("user_id", "event_type").distinct()
    return pairs(events.where("value > 40")).join(users("purchase"), "user_id", "left_semi"), pairs(events.where("event_id % 2 = 0")), users("purchase"), users("purchase", "signup")


for _accept in (False, True):

    @query("baseline_update_accepting" if _accept else "baseline_update", f"WITH {_RUN} SELECT user_id, event_type FROM a {'' if _accept else 'JOIN b USING (user_id, event_type)'} UNION SELECT user_id, event_type FROM b WHERE user_id NOT IN (SELECT user_id FROM ran) AND user_id IN (SELECT user_id FROM every)", "events")
    def _(events, accept=_accept):
        found, baseline, ran, every = _run(events)
        return structure.updated_baseline(baseline, found, ran, every, "user_id", accept)


_SIDE = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role || chr(10) || trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' ')) - 1 AS {}, role || chr(10) || trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' ') AS same FROM conversations WHERE {}"


@query("reconcile", f"""
        WITH a AS ({_SIDE.format("i", "turn % 3 <> 2")}), b AS ({_SIDE.format("j", "turn % 4 <> 1")}),
        m AS (SELECT conv_id, min(i) AS i, min(j) AS j FROM (SELECT conv_id, same, i, NULL AS j FROM a UNION ALL SELECT conv_id, same, NULL, j FROM b) GROUP BY conv_id, same HAVING count(i) = 1 AND count(j) = 1),
        sizes AS (SELECT conv_id, coalesce(n, 0) AS i, coalesce(k, 0) AS j FROM (SELECT conv_id, count(*) AS n FROM a GROUP BY 1) FULL JOIN (SELECT conv_id, count(*) AS k FROM b GROUP BY 1) USING (conv_id)),
        r AS (SELECT conv_id, i, j, last, coalesce(lag(i) OVER w, -1) AS pi, coalesce(lag(j) OVER w, -1) AS pj FROM (SELECT *, false AS last FROM m UNION ALL SELECT *, true FROM sizes) WINDOW w AS (PARTITION BY conv_id ORDER BY i, j)),
        g AS (SELECT *, i > pi + 1 OR j > pj + 1 AS gap FROM r), u AS (SELECT *, sum(CAST(gap AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g),
        s AS (SELECT conv_id, CASE WHEN i = pi + 1 THEN 'insert' WHEN j = pj + 1 THEN 'delete' ELSE 'replace' END AS tag, pi + 1 AS old_from, i AS old_to, pj + 1 AS new_from, j AS new_to FROM g WHERE gap
              UNION ALL SELECT conv_id, 'equal', min(i), max(i) + 1, min(j), max(j) + 1 FROM u WHERE NOT last GROUP BY conv_id, run)
        SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY old_from, new_from) - 1 AS INTEGER) AS step, tag, CAST(old_from AS INTEGER) AS old_from, CAST(old_to AS INTEGER) AS old_to, CAST(new_from AS INTEGER) AS new_from, CAST(new_to AS INTEGER) AS new_to FROM s""", "conversations")  # fmt: skip
def _(conversations):
    """Two versions of each conversation, of which each lacks some turns. The SQL relies on texts that are said once in a conversation, as those of the tables are."""
    chats = conversations.withColumn("same", reconcile.signature(F.col("role"), F.col("text")))
    return reconcile.aligned(chats.where("turn % 3 <> 2"), chats.where("turn % 4 <> 1"), "conv_id", "turn", "same")


for _kind, _test in (("new", "b.user_id IS NULL"), ("fixed", "a.user_id IS NULL"), ("known", "a.user_id = b.user_id")):
    _SQL = f"WITH {_RUN} SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type FROM a FULL JOIN (SELECT * FROM b WHERE user_id IN (SELECT user_id FROM ran)) b ON a.user_id = b.user_id AND a.event_type = b.event_type WHERE {_test}"

    @query(f"baseline_{_kind}", _SQL, "events")
    def _(events, kind=_kind):
        found, baseline, ran, _ = _run(events)
        return findings.diff(found, baseline, ran, "user_id").where(F.col("status") == kind).drop("status")
