import json

from scriptorium.sources import reports


def test_reports(spark):
    rows = spark.createDataFrame([(1, 2, "warning", "ref"), (1, 1, "error", "math"), (1, 3, "warning", "ref"), (2, 1, "warning", "cite")], "doc long, pos int, severity string, construct string")
    got = {r["doc"]: json.loads(r["report"]) for r in reports.entries_report(rows, "doc").collect()}
    assert (got[1]["warnings"], got[1]["errors"], got[2]["warnings"], got[2]["errors"]) == (2, 1, 1, 0)
    assert got[1]["constructs"] == [{"construct": "math", "severity": "error", "n": 1}, {"construct": "ref", "severity": "warning", "n": 2}]
    whole = {r["doc"]: json.loads(r["manifest"]) for r in reports.manifest(rows, "doc", "pos").collect()}
    assert [x["construct"] for x in whole[1]] == ["math", "ref", "ref"] and list(whole[2][0]) == ["construct", "pos", "severity"]
