from scriptorium.sources import bibtex

FILE = r"""stray } text, @string{acm = "ACM {Press}"} note
@Article{knuth84, Author = {Knuth, Donald and {Bib, Inc}}, title = "The {T{e{X}}}, = @ book", year = 1984,}
@comment{x, a = 1}
@book( odd )
@book{two,
  publisher = acm, pages = {1--2}, pages = {3--4 \& 5~6}
}
@misc{knuth85}
@misc{two, note = {last {wins}}}
"""


def test_fields(spark):
    files = spark.createDataFrame([("a", FILE), ("b", "@x{two, publisher = acm}"), ("c", None), ("d", "")], "path string, text string")
    got = {(r.path, r.key, r.name): (r.type, r.value) for r in bibtex.fields(files).collect()}
    assert got == {
        ("a", "knuth84", "author"): ("article", "Knuth, Donald and {Bib, Inc}"),
        ("a", "knuth84", "title"): ("article", "The {T{e{X}}}, = @ book"),
        ("a", "knuth84", "year"): ("article", "1984"),
        ("a", "two", "note"): ("misc", "last {wins}"),
        ("b", "two", "publisher"): ("x", "acm"),
    }
    more = FILE.replace("@misc{two", "@misc{three")
    got = {r.name: r.value for r in bibtex.fields(spark.createDataFrame([("a", more)], "path string, text string")).where("key = 'two'").select("name", bibtex.plain_value("value").alias("value")).collect()}
    assert got == {"publisher": "ACM Press", "pages": "3–4 & 5 6"}
    assert bibtex.fields(files.limit(0)).count() == 0


def test_files_are_dealt_by_size_and_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(bibtex, "PART", 4096)
    files = spark.range(400).selectExpr("CAST(id AS STRING) AS path", "concat('@string{p = {P, ', id, '}} @a{k', id, ', t = {{x, = \"}, ﷐1}, u = P, v = \"{\"}, w = 1\"}') AS text")
    got = bibtex.fields(files)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert got.rdd.getNumPartitions() >= 400 * 60 // 4096 > 4
    rows = {(r.path, r.name): r.value for r in got.collect()}
    assert len(rows) == 1200
    assert rows["7", "t"] == '{x, = "}, ﷐1' and rows["7", "u"] == "P, 7" and rows["7", "v"] == '{"}, w = 1'
