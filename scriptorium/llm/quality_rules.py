"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Counts of each whole text (words, symbols, repeated lines and word windows) decide the base rules. Texts that pass are
vectors of transformed statistics. For each language and source, each language and all texts, the mean and covariance
of the subset of least covariance determinant are estimated: from two robust starts, concentration steps take the share
KEEP of the texts with the smallest Mahalanobis distances until no determinant changes by more than STILL (STEPS at
most), and the start that ends with the smaller determinant counts. Texts farther than CUT (a chi-squared quantile) are
rejected. A step is one aggregation: distances are put in narrow buckets, whose sums give both the boundary and the
next estimate, so a source of any size costs a few hundred rows after the map side.

The estimate of a language and source counts as many times as it has texts in its subset, that of its language PRIOR
times, and so that of the language against that of all texts: a group of any size is judged, a small one mostly by what
it belongs to. Variances have a floor (FLOOR squared) so that statistics which are constant in most texts don't reject
every other.

Cases: null and empty texts have no words and fail the base rules, as do all under fifty words. Null lang or source is
a group of its own. Null doc_id is returned as it is; repeated rows all count. Texts at equal distances are taken into
a subset together; of equal determinants the first start counts. Other columns are ignored, whatever their names. Very
long texts are taken whole, one at a time. An empty table gives no rows, and where no text passes none is kept.
Windows of three words are compared by a 64-bit hash within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scriptorium.llm.shared import keep, small_or_shuffled

SPACE = r"[\x20\x09-\x0D]+"
KEEP, STEPS, STILL, PRIOR, FINE = 0.75, 12, 0.01, 50, 32
#: For five statistics: the chi-squared quantile at 1 - 1e-6, and what makes the covariance of the closest 75 % consistent.
CUT, CONSISTENT = 35.89, 1.41
FLOOR = (0.06, 0.15, 0.15, 0.07, 0.9)
P = len(FLOOR)
X = [f"x{i}" for i in range(P)]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, and the counts of each text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.select("doc_id", "lang", "source", F.array_remove(F.split("text", SPACE, -1), "").alias("w"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("l"))
    three = F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    out = out.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.slice(three, 1, F.greatest(F.size("w") - 2, F.lit(0))).alias("h"),
    )
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    none = F.slice(pairs, 1, 0)
    out = out.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs).otherwise(none)).drop("h")
    twice = F.filter("s", lambda x, k: (x["h"] == F.get("s", k - 1)["h"]) | (x["h"] == F.get("s", k + 1)["h"]))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-9).alias("last"))
    covered = F.aggregate(places, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    out = out.withColumn("n_repeat_words", covered.cast("long")).drop("s")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vectors(stats: DataFrame) -> DataFrame:
    """stats with x0 to x4: log word length, log shares of symbols and repeated lines, share of repeated words, log size."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    values = [F.log(F.greatest("word_chars", F.lit(1)) / n), F.log1p(20 * F.col("n_symbols") / n), F.log1p(50 * F.col("n_dup_lines") / n), F.col("n_repeat_words") / n, F.log(n)]
    return stats.withColumns(dict(zip(X, values)))


CELLS = [(i, j) for i in range(P) for j in range(i + 1)]
MOMENTS = ["n", *(f"m{i}" for i in range(P)), *(f"c{i}{j}" for i, j in CELLS)]


def _moments(sums: DataFrame) -> DataFrame:
    """Per key and start, from n, s_i and s_ij: n, the means m_i and the covariances c_ij."""
    out = sums.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(P)})
    out = out.withColumns({f"c{i}{j}": F.col(f"s{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") + (F.lit(FLOOR[i] ** 2) if i == j else F.lit(0.0)) for i, j in CELLS})
    return out.select("key", "start", *MOMENTS)


def _inverted(out: DataFrame) -> DataFrame:
    """From m_i and c_ij: the inverse of the covariance's Cholesky factor v_ij and log_det, which distances need, beside them."""
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    for j in range(P):
        for i in range(j, P):
            value = F.lit(1.0) if i == j else -sum((F.col(f"l{i}{k}") * F.col(f"v{k}{j}") for k in range(j, i)), F.lit(0.0))
            out = out.withColumn(f"v{i}{j}", value / F.col(f"l{i}{i}"))
    log_det = sum((F.log(F.col(f"l{i}{i}")) for i in range(P)), F.lit(0.0))
    return out.select("key", "start", log_det.alias("log_det"), *MOMENTS, *(f"v{i}{j}" for i, j in CELLS))


def distance() -> Column:
    """The squared Mahalanobis distance of a row joined to its group's estimate."""
    total = F.lit(0.0)
    for i in range(P):
        z = sum((F.col(f"v{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0))
        total = total + z * z
    return total


def _starts(rows: DataFrame) -> DataFrame:
    """Two diagonal estimates per key around the medians: scaled by the quartiles, and by the floors alone."""
    quartiles = rows.groupBy("key").agg(*(F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000).alias(x) for x in X))
    both = quartiles.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("n", F.lit(0).cast("long"))
    mean = {f"m{i}": F.get(x, 1) for i, x in enumerate(X)}
    spread = [F.when(F.col("start") == 0, F.greatest((F.get(x, 2) - F.get(x, 0)) / 1.349, F.lit(FLOOR[i]))).otherwise(FLOOR[i]) for i, x in enumerate(X)]
    cells = {f"c{i}{j}": spread[i] * spread[i] if i == j else F.lit(0.0) for i in range(P) for j in range(i + 1)}
    return _inverted(both.withColumns({**mean, **cells}))


def estimates(rows: DataFrame) -> DataFrame:
    """Of rows (key, x0 to x4), the moments of least determinant for each key."""
    now = keep(_starts(rows), "estimates")
    products = [(f"s{i}", F.col(x)) for i, x in enumerate(X)] + [(f"s{i}_{j}", F.col(X[i]) * F.col(X[j])) for i, j in CELLS]
    for _ in range(STEPS):
        near = rows.join(small_or_shuffled(now.drop("n")), "key").withColumn("bucket", F.floor(F.log(distance() + 1e-6) * FINE))
        sums = near.groupBy("key", "start", "bucket").agg(F.count("*").alias("n"), *(F.sum(v).alias(k) for k, v in products))
        own = Window.partitionBy("key", "start")  # a few hundred buckets each
        sums = sums.withColumn("all", F.sum("n").over(own)).withColumn("before", F.sum("n").over(own.orderBy("bucket")) - F.col("n"))
        closest = sums.where(F.col("before") < KEEP * F.col("all")).groupBy("key", "start").agg(F.sum("n").alias("n"), *(F.sum(k).alias(k) for k, _ in products))
        last, now = now.select("key", "start", F.col("log_det").alias("last")), keep(_inverted(_moments(closest)), "estimates")
        if now.join(last, ["key", "start"]).where(F.abs(F.col("log_det") - F.col("last")) > STILL).isEmpty():
            break
    best = now.groupBy("key").agg(F.min(F.struct("log_det", "start")).alias("b")).select("key", F.col("b.start").alias("start"))
    return now.join(best, ["key", "start"]).select("key", *MOMENTS)


def _shrunk(own: DataFrame, parent: DataFrame) -> DataFrame:
    """Moments of own (key, up and more), drawn towards those of parent (key), which count as PRIOR texts."""
    side = parent.select(F.col("key").alias("up"), *(F.col(m).alias(f"up_{m}") for m in MOMENTS))
    weight = F.col("n") / (F.col("n") + PRIOR)
    mixed = {m: weight * F.col(m) + (1 - weight) * F.col(f"up_{m}") for m in MOMENTS[1:]}
    return own.join(side, "up").withColumns(mixed).drop("up", *(f"up_{m}" for m in MOMENTS))


def judged(stats: DataFrame) -> DataFrame:
    """stats (lang, source, base_failed, x0 to x4) with distance, null where there is no text that passes."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.replace(F.col(c), F.lit("\n"), F.lit("\\n"))), F.lit("-"))
    stats = stats.withColumn("pool", name("lang")).withColumn("key", F.concat_ws("\n", name("lang"), name("source")))
    good = stats.where("NOT base_failed")
    levels = good.withColumn("key", F.explode(F.array("key", "pool", F.lit("")))).select("key", *X)
    found = keep(estimates(levels), "moments")
    of_all = found.where("key = ''")
    pools = _shrunk(found.where("key <> '' AND instr(key, '\n') = 0").withColumn("up", F.lit("")), of_all)
    names = good.select("key", F.col("pool").alias("up")).distinct()
    pairs = _shrunk(found.join(names, "key"), pools).withColumn("start", F.lit(0))
    pairs = keep(_inverted(pairs).drop("n"), "estimate")
    return stats.join(small_or_shuffled(pairs), "key", "left").withColumn("distance", distance() / CONSISTENT)


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance."""
    out = judged(vectors(keep(statistics(docs), "statistics")))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUT)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
