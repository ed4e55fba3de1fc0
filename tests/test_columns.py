"""Awkward column specifications."""

from scriptorium.sources.columns import columns


def test_columns(spark):
    specs = {
        "lcr": [("l", "left"), ("c", "center"), ("r", "right")],
        "": [],
        "*{x}{l}*{-1}{c}*{0}{c}": [("l", "left")],
        "*{2}{*{2}{r|}c}": [("r", "right"), ("r", "right"), ("c", "center")] * 2,
        ">{\\centering\\arraybackslash}X l>{\\raggedleft} D{.}{,}{2}": [("X", "center"), ("l", "left"), ("D", "right")],
        "@{l}!{c}<{r}p{2cm}p q S[table-format=1.1, l]c": [("p", "left"), ("S", "center"), ("c", "center")],
        "*{3}{l": [],
        "l}r": [("l", "left"), ("r", "right")],
        "*{12}{l}": [("l", "left")] * 12,
    }
    rows = list(enumerate(specs)) + [(99, None)]
    got = {i: [] for i, _ in rows}
    for r in columns(spark.createDataFrame(rows, "path int, source string")).orderBy("path", "number").collect():
        assert r.number == len(got[r.path])
        assert r.width == (720000 if r.type == "p" else None)
        got[r.path].append((r.type, r.alignment))
    assert got.pop(99) == []
    for i, spec in enumerate(specs):
        assert got[i] == specs[spec], spec


def test_tasks_stay_small_as_specifications_grow(spark, monkeypatch):
    from scriptorium.sources import columns as C

    monkeypatch.setattr(C, "PART", 400, raising=False)
    specs = spark.range(300).selectExpr("id AS path", "concat('Some words l *{2}{p{', 1 + id % 9, 'cm}>{\\\\\\\\centering}X}r') AS source")
    got = columns(specs)
    assert got.rdd.getNumPartitions() > 300 * 20 // 400
    rows = {(r.path, r.number): (r.type, r.alignment, r.width) for r in got.collect()}
    assert [rows[4, n] for n in range(7)] == [("S", "center", None), ("m", "left", None)][:1] + [("r", "right", None), ("l", "left", None)] + [("p", "left", 1800000), ("X", "center", None)] * 2
    assert rows[4, 7] == ("r", "right", None) and len(rows) == 300 * 8
