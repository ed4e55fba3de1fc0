"""What operators leave on disk and in the workers while they run."""

from pathlib import Path

from pyspark.sql import functions as F

from scriptorium.llm import ngram_join, substring_dedup
from scriptorium.llm.shared import keep, shared_folder


def test_kept_tables_leave_no_shuffle_files(spark):
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {p for d in folder for p in Path(d.getPath()).glob("*/shuffle_*")}
    before = files()
    df = spark.range(20_000).groupBy((F.col("id") % 977).alias("g")).count()
    other = spark.range(2_000).groupBy((F.col("id") % 1_009).alias("g")).agg(F.max("id").alias("m"))
    assert keep(df.join(other.hint("merge"), "g"), "joined").count() == 977
    assert keep(df, "again").count() == 977  # the same frame can be computed again
    left = [p for p in files() - before if p.suffix == ".data"]
    assert len(left) <= 2, left  # those of the two counts, which wrote no table
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_sketches_are_made_by_the_worker_that_reads_the_text(spark, docs):
    texts = docs([(1, "a b c d e f g"), (2, "h i j k l m n o"), (2, "p q r s t u"), (3, None)])
    classes = ngram_join.signatures(texts).where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("first"))
    got = ngram_join._sketches(texts, keep(classes, "classes"), True)
    assert got._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    assert sorted(r["n"] for r in got.collect()) == [2, 3, 4]
    sets = {r["cid"]: r["s"] for r in ngram_join._sets_of(texts, keep(classes, "classes"), True).collect()}
    for r in got.collect():
        odd = {v & (ngram_join.SKETCH - 1) for v in sets[r["cid"]]}
        assert sum(bin(b).count("1") for b in r["k"]) == len(odd) and len(r["k"]) == ngram_join.SKETCH // 8


def test_substring_dedup_drops_tables_that_nothing_reads_again(spark, docs):
    same = " ".join(f"w{i}" for i in range(80))
    texts = docs([(i, f"{same} {' '.join(f'x{i}y{j}' for j in range(70))}") for i in range(12)])
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("*")) if folder.exists() else set()
    found = substring_dedup.passages(texts)
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before}
    assert not left & {"windows", "twice", "texts", "pairs"} and "passages" in left, left
    rows = found.collect()
    assert {(r["doc_id"], r["source_id"], r["first_word"], r["last_word"]) for r in rows} == {(i, 0, 0, 79) for i in range(1, 12)}
