"""Options, units, conditionals, overlays and languages on awkward inputs."""

from pyspark.sql import functions as F

from scriptorium.functions import bibliography as B
from scriptorium.functions import markup as M
from scriptorium.operators import units
from scriptorium.sources import preambles


def one(spark, f, *values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"c {kind}").select(f(F.col("c"))).collect()]


def test_key_values(spark):
    got = one(spark, M.key_values, "a=1, b={x, {y}=2}, draft, a = 3", "", None, ",,", "t={{a}}, u=p=q")
    assert got == [{"a": "3", "b": "x, {y}=2", "draft": "true"}, {}, None, {}, {"t": "{a}", "u": "p=q"}]


def test_image_options(spark):
    got = one(spark, M.image_options, r"width=0.5\linewidth, height=2cm, trim=1mm 2mm 3mm 4mm, clip", "width=10, scale=x, angle=-90, trim=1mm")
    assert (got[0].width, got[0].height, got[0].trim, got[0].clip, got[0].keep_aspect) == (None, 720000, [36000, 72000, 108000, 144000], True, False)
    assert (got[1].width, got[1].scale, got[1].angle, got[1].trim, got[1].clip) == (126526, None, -90.0, None, False)  # ten points


def test_option_lists_are_read_once_a_row(spark):
    rows = spark.createDataFrame([("a=1",)], "c string")
    shown = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    assert shown(rows.select(M.key_values(F.col("c")).alias("m"))) == 1
    assert shown(rows.select(M.image_options(F.col("c")).alias("o")).select("o.width", "o.trim", "o.clip", "o.alt")) == 1
    assert one(spark, M.image_options, "alt={a,b}", "x", None)[0].alt == "a,b"


def test_units(spark):
    lists = (["kilo", "gram", "metre", "per", "second", "squared"], ["cubic", "centi", "metre"], ["newton", "kilo", "metre"], [], ["metre", "odd"], ["per", "second"], ["square", "milli", "metre", "cubed"], ["metre"] * 40)
    rows = units.unit_texts(spark.createDataFrame(list(enumerate(lists)), "id int, names array<string>"), "id", "names")
    assert [r.text for r in rows.orderBy("id").collect()] == ["kg\u2009m/s²", "cm³", "N\u2009km", "", "modd", "/s", "mm²³", "\u2009".join("m" * 40)]


def test_false_blocks(spark):
    got = one(
        spark, M.without_false_blocks, r"a\iffalse b\fi c", r"a\iffalse b\ifx c\else d\fi e\else f\ifnum1>0 g\else h\fi\fi i", r"a\iffalse b", r"\fill\ifx a\fi", r"\iffalse a\else b\else c\fi d\iffalse e\fi f", "", None
    )
    assert got == ["a c", r"a f\ifnum1>0 g\else h\fi i", "a", r"\fill\ifx a\fi", r" b\else c d f", "", None]


def test_overlays(spark):
    assert one(spark, M.without_overlays, r"\item<2-> a \only <3>{b} \itemx<4> 1<2>1", None) == [r"\item a \only{b} \itemx<4> 1<2>1", None]


def test_main_language(spark):
    sources = (
        r"\usepackage[english,ngerman]{babel}", r"\usepackage[main=french,english]{babel}", r"\setmainlanguage{Dutch}\usepackage[english]{babel}", r"\documentclass[a4paper,polish]{article}", r"\usepackage[unknown]{babel}", ""
    )
    rows = preambles.main_languages(spark.createDataFrame(list(enumerate(sources)), "path int, source string"))
    assert [r.lang for r in rows.orderBy("path").collect()] == ["de-DE", "fr-FR", "nl-NL", "pl-PL", None, None]


def test_dingbats(spark):
    assert one(spark, M.dingbat, "51", "172", "191", " 201 ", "7", "x", None) == ["✓", "➀", "❿", "➓", "•", "•", "•"]


def test_running_head(spark):
    sources = (r"\title[a  b]{c}", r"\runninghead{a {b{c}} }\title{x}", r"\markboth{l}{ r }", r"\markright{}\shorttitle{s}", r"\runninghead{open", "", None)
    rows = preambles.running_heads(spark.createDataFrame(list(enumerate(sources)), "path int, source string"))
    assert [r["head"] for r in rows.orderBy("path").collect()] == ["a b", "a {b{c}}", "r", "s", None, None, None]


def test_accents(spark):
    rows = spark.createDataFrame([("'", "e"), ('"', "ı"), ("v", "Sx"), ("~", "q"), ("c", ""), ("?", "a"), ("^", None)], "n string, b string")
    assert [r[0] for r in rows.select(M.accented(F.col("n"), F.col("b"))).collect()] == ["é", "ï", "Šx", "q̃", "̧", "a", None]


def test_numeric_id(spark):
    import zlib

    assert one(spark, B.numeric_id, "knuth84", "é") == [zlib.crc32(k.encode()) & 0x7FFFFFFF for k in ("knuth84", "é")]
