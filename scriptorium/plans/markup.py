"""Queries for options, units, conditionals, overlays, languages, text boxes and glossaries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import markup as M
from scriptorium.operators import refs, scopes, units
from scriptorium.plans.queries import query
from scriptorium.sources import preambles


@query("key_values", "SELECT p_partkey, 'draft' AS key, 'true' AS value FROM part UNION ALL SELECT p_partkey, 'title', p_name || ', {' || p_type || '}' FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size + 1 AS VARCHAR) FROM part", "part")
def _(part):
    options = F.concat(F.lit("size="), "p_size", F.lit(", title={"), "p_name", F.lit(", {"), "p_type", F.lit("}}, draft,, size = "), F.col("p_size") + 1)
    return part.select("p_partkey", F.explode(M.key_values(options)))


_UNITS = {"cm": 360000, "mm": 36000, "in": 914400, "PT": "914400 / 72.27", "bp": 12700, "px": 9525, "em": "9144000 / 72.27", "ex": "3931920 / 72.27", "": "914400 / 72.27"}
_UNIT = "['" + "', '".join(_UNITS) + "'][1 + CAST(floor(p_retailprice) AS BIGINT) % 9]"
_EMU_OF = "[" + ", ".join(f"CAST({v} AS DOUBLE)" for v in _UNITS.values()) + "][1 + CAST(floor(p_retailprice) AS BIGINT) % 9]"


@query("image_options", f"SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN CAST(round(p_size * {_EMU_OF}) AS BIGINT) END AS width, CAST(round(p_size * 914400 / 72.27) AS BIGINT) AS height, p_size / 4.0 AS scale, CAST(-p_size AS DOUBLE) AS angle, CAST(p_size * 36000 AS BIGINT) AS trim_right, p_size % 2 = 0 AS clip, false AS keep_aspect, p_name || ',' || p_brand AS alt FROM part", "part")
def _(part):
    size, unit = F.col("p_size"), F.get(F.array(*map(F.lit, _UNITS)), (F.floor("p_retailprice") % 9).cast("int"))
    width = F.when(size % 3 == 0, F.lit(r"0.5\linewidth")).otherwise(F.concat(size, unit))
    options = F.concat(F.lit("Width="), width, F.lit(",HEIGHT="), size, F.lit(",scale="), size / 4, F.lit(",Angle=-"), size, F.lit(",trim=1pt 2pt "), size, F.lit("mm 0pt,alt={"), "p_name", F.lit(","), "p_brand", F.lit("},x=[1,clip]"), F.when(size % 2 == 0, ",Clip").otherwise(""))
    return part.select("p_partkey", M.image_options(options).alias("o")).select("p_partkey", "o.width", "o.height", "o.scale", "o.angle", F.get("o.trim", 2).alias("trim_right"), "o.clip", "o.keep_aspect", "o.alt")


@query("unit_texts", "SELECT p_partkey, ['k', 'm', 'µ'][1 + p_partkey % 3] || ['N', 'Pa', 'mol', 'Ω'][1 + p_size % 4] || chr(8201) || 'm' || CASE WHEN p_size % 2 = 0 THEN '²' ELSE '³' END || '/s' || CASE WHEN p_size % 5 = 0 THEN '²' ELSE '' END AS text FROM part", "part")
def _(part):
    pick = lambda c, *names: F.get(F.array(*map(F.lit, names)), F.pmod(F.col(c), F.lit(len(names))).cast("int"))
    tail = F.when(F.col("p_size") % 5 == 0, F.array(F.lit("squared"))).otherwise(F.array().cast("array<string>"))
    names = F.concat(F.array(pick("p_partkey", "kilo", "milli", "micro"), pick("p_size", "newton", "pascal", "mole", "ohm"), pick("p_size", "square", "cubic"), F.lit("metre"), F.lit("per"), F.lit("second")), tail)
    return units.unit_texts(part.select("p_partkey", names.alias("names")), "p_partkey", "names")


@query("false_blocks", "SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM (SELECT doc_id, coalesce(text, '') || ' ' || coalesce(source, '') || '\\ifx ' || coalesce(text, '') || '\\fi' AS text FROM documents)", "documents")
def _(documents):
    text, lang, source = (F.coalesce(c, F.lit("")) for c in ("text", "lang", "source"))
    block = F.concat(F.lit(r"\iffalse "), lang, F.lit(r"\ifx a\else b\fi "), text, F.lit(r"\else "), source, F.lit(r"\ifx "), text, F.lit(r"\fi\fi"))
    rest = M.without_false_blocks(F.concat(text, block, F.lit(r"\iffalse "), text))
    return documents.select("doc_id", rest.alias("text")).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query("overlays", "SELECT doc_id, md5('\\item ' || coalesce(text, '') || ' \\only{' || coalesce(lang, '') || '}<1>') AS digest FROM documents", "documents")
def _(documents):
    text, lang = (F.coalesce(c, F.lit("")) for c in ("text", "lang"))
    slides = F.concat(F.lit(r"\item<2-> "), text, F.lit(r" \only <1,3>{"), lang, F.lit("}<1>"))
    return documents.select("doc_id", F.md5(M.without_overlays(slides)).alias("digest"))


@query("main_languages", "SELECT c_custkey, [CASE WHEN c_nationkey % 2 = 0 THEN 'nl-NL' ELSE 'de-DE' END, 'fr-FR', 'de-DE', 'pl-PL', NULL][1 + c_custkey % 5] AS lang FROM customer", "customer")
def _(customer):
    poly = F.concat(F.lit(r"\setmainlanguage{"), F.when(F.col("c_nationkey") % 2 == 0, "Dutch").otherwise("other"), F.lit(r"}\usepackage[english,ngerman,x]{babel}"))
    others = [r"\usepackage[main=french,english]{babel}", r"\documentclass[polish]{a}\usepackage[english,german]{babel}", r"\documentclass[a4paper, Polish]{article}\usepackage[x]{babel}", r"\usepackage{babel}"]
    preamble = F.get(F.array(poly, *map(F.lit, others)), F.pmod("c_custkey", F.lit(5)).cast("int"))
    return preambles.main_languages(customer.select(F.col("c_custkey").alias("path"), preamble.alias("source"))).withColumnRenamed("path", "c_custkey")


@query("text_boxes", "SELECT p_partkey, 635 * CAST(greatest(p_size * 400 - CASE WHEN p_partkey % 4 = 0 THEN 1440 ELSE p_partkey % 3000 END - 1000, 1440) AS BIGINT) AS width, 635 * CAST(greatest(15840 - p_partkey % 3000 - 1440, 1440) AS BIGINT) AS height FROM part", "part")
def _(part):
    margin = F.col("p_partkey") % 3000
    none = F.lit(None).cast("int")
    box = M.text_box(F.col("p_size") * 400, none, margin, F.lit(1000), none, F.when(F.col("p_partkey") % 4 != 0, margin))
    return part.select("p_partkey", box.alias("box")).select("p_partkey", "box.*")


@query("dingbats", "SELECT p_partkey, CASE WHEN n = 51 THEN '✓' WHEN n = 52 THEN '✔' WHEN n IN (53, 55) THEN '✗' WHEN n IN (54, 56) THEN '✘' WHEN n BETWEEN 172 AND 181 THEN chr(CAST(10112 + n - 172 AS INTEGER)) WHEN n BETWEEN 182 AND 191 THEN chr(CAST(10102 + n - 182 AS INTEGER)) WHEN n BETWEEN 192 AND 201 THEN chr(CAST(10122 + n - 192 AS INTEGER)) ELSE '•' END AS mark FROM (SELECT p_partkey, p_partkey % 210 AS n FROM part)", "part")
def _(part):
    return part.select("p_partkey", M.dingbat(F.col("p_partkey") % 210).alias("mark"))


_COMMANDS = ["gls", "Gls", "glspl", "Glspl", "acrshort", "acrlong", "acrfull", "Acrlong"]
_ACRONYMS = "p_partkey % 3 = 0"


@query(
    "glossary_texts",
    f"WITH u AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, {_COMMANDS}[1 + l_orderkey % 8] AS c, l_orderkey % 8 < 4 AS g FROM lineitem), "
    "n AS (SELECT *, CASE WHEN c LIKE '%pl' THEN 's' ELSE '' END AS s, row_number() OVER (PARTITION BY l_suppkey, l_partkey, g ORDER BY l_orderkey, l_linenumber) > 1 AS again FROM u), "
    "t AS (SELECT l_orderkey, l_linenumber, c, l_partkey, CASE WHEN p_partkey % 3 = 0 AND c ILIKE 'acrlong' THEN p_name WHEN p_partkey % 3 = 0 AND (c = 'acrfull' OR (g AND NOT again)) THEN p_name || s || ' (' || p_brand || s || ')' "
    "WHEN p_partkey % 3 = 0 THEN p_brand || s WHEN p_partkey % 3 = 1 THEN p_name || s END AS text FROM n LEFT JOIN part ON l_partkey = p_partkey) "
    "SELECT l_orderkey, l_linenumber, CASE WHEN text IS NULL THEN CAST(l_partkey AS VARCHAR) WHEN c IN ('Gls', 'Glspl', 'Acrlong') THEN upper(text[1]) || text[2:] ELSE text END AS text FROM t",
    "lineitem",
    "part",
)
def _(lineitem, part):
    uses = lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("label"), F.get(F.array(*map(F.lit, _COMMANDS)), (F.col("l_orderkey") % 8).cast("int")).alias("command"))
    acronyms = part.where(_ACRONYMS).select(F.col("p_partkey").alias("label"), F.col("p_brand").alias("short"), F.col("p_name").alias("long"))
    terms = part.where("p_partkey % 3 = 1").select(F.col("p_partkey").alias("label"), F.col("p_name").alias("name"))
    return refs.glossary_texts(uses, ["l_suppkey"], ["l_orderkey", "l_linenumber"], acronyms, terms).select("l_orderkey", "l_linenumber", "text")


@query("glossary_list", "SELECT CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS section, p_partkey AS position, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE CAST(p_partkey AS VARCHAR) END AS term, p_name AS description FROM part WHERE p_partkey % 3 < 2", "part")
def _(part):
    position, description = F.col("p_partkey").alias("position"), F.col("p_name").alias("description")
    acronyms = part.where(_ACRONYMS).select(F.lit(0).alias("section"), position, F.col("p_brand").alias("term"), description)
    terms = part.where("p_partkey % 3 = 1").select(F.lit(1).alias("section"), position, F.col("p_partkey").cast("string").alias("term"), description)
    return acronyms.unionByName(terms).orderBy("section", "position")


@query("accents", "SELECT p_partkey, nfc_normalize(base[1] || chr(a) || base[2:]) AS text FROM (SELECT p_partkey, p_name AS base, [769, 768, 770, 776, 771, 772, 775, 780, 774, 807, 779, 778][1 + p_partkey % 12] AS a FROM part)", "part")
def _(part):
    name = F.get(F.array(*map(F.lit, M.ACCENTS)), (F.col("p_partkey") % 12).cast("int"))
    return part.select("p_partkey", M.accented(name, F.col("p_name")).alias("text"))


@query("running_heads", "SELECT p_partkey, [p_name, p_type || ' {' || p_name || '}', p_brand, NULL][1 + p_partkey % 4] AS head FROM part", "part")
def _(part):
    kinds = [
        F.concat(F.lit(r"\shorttitle{x}\title [ "), "p_name", F.lit(" ]{y}")),
        F.concat(F.lit(r"\markboth{a}{b}\titlerunning{z}\markright[o] {"), "p_type", F.lit("  {"), "p_name", F.lit("}}")),
        F.concat(F.lit(r"\markright{open \markboth{a} {"), "p_brand", F.lit("}")),
        F.lit(r"\title{long}"),
    ]
    sources = part.select(F.col("p_partkey").alias("path"), F.get(F.array(*kinds), (F.col("p_partkey") % 4).cast("int")).alias("source"))
    return preambles.running_heads(sources).withColumnRenamed("path", "p_partkey")


@query("fonts", "SELECT p_partkey, p_name AS main_font, CASE WHEN p_size % 2 = 0 THEN p_brand END AS cjk_font FROM part", "part")
def _(part):
    preamble = F.concat(F.lit(r"\setmainfont[Scale=1]{ "), "p_name", F.lit(r"}\setCJKmainfont {"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(" "), F.lit("}"))
    sources = part.select(F.col("p_partkey").alias("path"), preamble.alias("source"))
    both = preambles.fonts(sources, "setmainfont").withColumnRenamed("font", "main_font").join(preambles.fonts(sources, "setCJKmainfont").withColumnRenamed("font", "cjk_font"), "path")
    return both.withColumnRenamed("path", "p_partkey")


@query("locators", "SELECT p_partkey, CASE WHEN p_partkey % 4 > 1 AND p_size % 3 > 0 THEN p_brand END AS prefix, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN p_size % 3 > 0 THEN p_brand END ELSE p_type END AS suffix FROM part", "part")
def _(part):
    options = F.slice(F.array(F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).otherwise(""), "p_type", "p_name"), F.lit(1), (F.col("p_partkey") % 4).cast("int"))
    return part.select("p_partkey", M.locators(options).alias("l")).select("p_partkey", "l.prefix", "l.suffix")


@query("math_fingerprints", r"SELECT doc_id, md5(regexp_replace(lower(regexp_replace(regexp_replace('\to|' || coalesce(text, '') || '( ) [3, p. 2]|', '\[\d[^\]]*\]|\(\s*\)', '', 'g'), '[\s{}]+', '', 'g')), '[:_]', '', 'g')) AS digest FROM documents", "documents")
def _(documents):
    text = F.concat(F.lit(r"\displaystyle \rightarrow\|"), F.coalesce("text", F.lit("")), F.lit(r"( ) [3, p. 2]\begin{matrix}\end{matrix}\|"))
    return documents.select("doc_id", F.md5(M.math_fingerprint(text)).alias("digest"))


@query("theorem_titles", "SELECT p_partkey, p_name || ' ' || p_type AS title FROM part", "part")
def _(part):
    raw = F.concat(F.lit(r"{\bfseries  "), "p_name", F.lit(r"} \textit{"), "p_type", F.lit("}"))
    return part.select("p_partkey", M.clean_title(raw).alias("title"))


@query("restored_labels", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'fig:' || p_partkey || '_a' WHEN 1 THEN 'Eq:' || p_partkey ELSE 'figure_' || p_partkey END AS label FROM part", "part")
def _(part):
    kind = F.get(F.array(*map(F.lit, ["fig_", "ref_Eq_", "figure_"])), (F.col("p_partkey") % 3).cast("int"))
    return part.select("p_partkey", M.restored_label(F.concat(kind, "p_partkey", F.when(F.col("p_partkey") % 3 == 0, "_a").otherwise(""))).alias("label"))


@query("pending_captions", "SELECT event_id, marker FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS marker FROM (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM events)) WHERE event_type = 'purchase'", "events")
def _(events):
    kind = F.col("event_type")
    return scopes.pending(events, ["user_id"], ["ts", "event_id"], F.when(kind == "click", F.col("event_id")), kind == "purchase").select("event_id", "marker")


@query("affiliation_marks", "SELECT conv_id, turn, coalesce(CASE WHEN length(text) % 5 = 0 THEN '*' END, CASE WHEN count(*) OVER (PARTITION BY conv_id, role) > 1 THEN CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS VARCHAR) END) AS mark FROM conversations", "conversations")
def _(conversations):
    own = F.when(F.length("text") % 5 == 0, "*")
    return scopes.listed_marks(conversations, ["conv_id", "role"], ["turn"], own).select("conv_id", "turn", "mark")
