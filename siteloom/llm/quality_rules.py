"""Quality rules: base rules on text statistics, then robust multivariate outliers.

For each language and source a minimum-covariance-determinant estimate of location and scatter
is sought over the whole table: from several starts (robust scales, spatial signs, small random
subsets) concentration steps take the half of the rows that is nearest under the present estimate
and its moments; the start whose determinant is least goes on until no determinant falls any more.
A last step takes all rows within the 97.5 % point of a chi-squared distribution.  As groups may be
small and most of their statistics may be zero, scatters are drawn towards the identity in
robustly standardised space, the regularised form of the estimate.

All of it is DataFrame aggregation over a narrow table of statistics; the estimates themselves are
a few short rows a group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import BLANK, materialise, only, row_key, same

_EDGE = " \t\n\x0b\x0c\r"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
P = len(STATS)
T = [f"t{i}" for i in range(P)]
#: Base rules.
MIN_WORDS, REPEAT_SHARE = 10, 20
#: Words at a group's usual rate that are added to each text, so that the rates of short texts do not stray by chance.
PRIOR_WORDS = 30
#: Least units of the transformed statistics: a factor e in words and doubled lines, a tenth in the others.
UNITS = [1.0, 0.1, 0.1, 1.0, 0.1]
#: Least share of the identity in a scatter; rows that it weighs as much as; rows of a random subset.
SHARE, WEIGHT, SUBSET = 0.25, 10, P + 1
#: Groups whose estimates are broadcast; beyond that rows and estimates meet by group and one of SALTS parts.
GROUPS, SALTS = 20_000, 16


def chi2(x: float, k: int) -> float:
    """Distribution function of a chi-squared variable with an odd number of degrees of freedom."""
    series, product = 0.0, 1.0
    for i in range(1, k, 2):
        product *= i
        series += x ** (i / 2) / product
    return math.erf(math.sqrt(x / 2)) - math.sqrt(2 / math.pi) * math.exp(-x / 2) * series


def chi2_point(share: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2(mid, k) < share else (low, mid)
    return low


def consistency(share: float) -> float:
    """What the scatter of the nearest ``share`` of normal rows is multiplied by to be that of all."""
    return share / chi2(chi2_point(share, P), P + 2)


def add_stats(docs: DataFrame, window: int = 5) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of the whole text.

    A null or blank text has none of each.  Equality of windows is that of 64-bit hashes within one document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_EDGE)) != "")
    df = docs.withColumns({"__t": F.btrim(text, F.lit(_EDGE)), "__l": lines})
    df = df.withColumn("__w", F.when(F.col("__t") != "", F.split("__t", BLANK)).otherwise(F.array().cast("array<string>")))
    n = F.size("__w")
    hashes = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*(F.get("__w", i + k) for k in range(window))))
    df = df.withColumn("__h", F.when(n >= window, hashes))
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    order = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__o", F.when(repeats, order))
    at = lambda i: F.get("__o", i)["h"]
    twice = F.filter("__o", lambda x, i: x["h"].eqNullSafe(at(i + 1)) | x["h"].eqNullSafe(at(i - 1)))
    df = df.withColumn("__p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("__p", lambda x, i: F.least(F.lit(window), F.coalesce(F.get("__p", i + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x
    )
    return df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.regexp_replace("__t", BLANK, "")).cast("long"),
            "n_symbols": (F.length("__t") - F.length(F.regexp_replace("__t", r"[#*$%&|<>]", ""))).cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop("__t", "__l", "__w", "__h", "__o", "__p")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))


def _meet(rows: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    """Rows (g, salt) with their group's short rows: broadcast if groups are few, else by group and salt, so that a very large group spreads."""
    if few:
        return rows.join(F.broadcast(table), "g")
    return rows.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["g", "salt"])


def _transformed(passed: DataFrame, few: bool) -> DataFrame:
    """t0 to t4: log words, log letters a word, symbols and repeated words for each word, log doubled lines, in robust units of their group."""
    n = F.col("n_words").cast("double")
    m = n + PRIOR_WORDS
    length = F.col("word_chars") / n
    usual = passed.groupBy("g").agg(F.percentile_approx(length, 0.5, 1000).alias("usual"))
    y = [F.log(n), F.log(length / F.col("usual")) * n / m, F.col("n_symbols") / m, F.log1p(F.col("n_dup_lines").cast("double")), F.col("n_repeat_words") / m]
    raw = _meet(passed, usual, few).select("doc_id", "rk", "g", "salt", *(c.alias(t) for c, t in zip(y, T, strict=True)))
    spans = raw.groupBy("g").agg(*(F.percentile_approx(t, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, t in enumerate(T)))
    unit = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(UNITS[i])) for i in range(P)]
    return _meet(raw, spans, few).select("doc_id", "rk", "g", "salt", *(((F.col(t) - F.col(f"q{i}")[1]) / unit[i]).alias(t) for i, t in enumerate(T)))


def _estimates(rows: DataFrame, factor: float, *keys: str) -> DataFrame:
    """keys, m_i, l_ij, fall: location, Cholesky factor and log determinant of the regularised scatter of each group of rows."""
    sums = [F.avg(t).alias(f"m{i}") for i, t in enumerate(T)] + [F.covar_pop(T[i], T[j]).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)]
    df = rows.groupBy(*keys).agg(F.greatest(F.lit(SHARE), WEIGHT / (F.count(F.lit(1)) + WEIGHT)).alias("rho"), *sums)
    return _factor(df, factor)


def _factor(df: DataFrame, factor: float) -> DataFrame:
    """c_ij, rho to l_ij and det, the log determinant: the Cholesky factor of (1 - rho) * factor * c + rho * identity."""
    rho = F.col("rho")
    for j in range(P):
        for i in range(j, P):
            rest = (1 - rho) * factor * F.col(f"c{i}{j}") + (rho if i == j else 0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    df = df.drop("rho", *(f"c{i}{j}" for i in range(P) for j in range(i + 1)))
    return df.withColumn("det", sum((2 * F.log(f"l{i}{i}") for i in range(1, P)), 2 * F.log("l00")))


def _distance(df: DataFrame) -> DataFrame:
    """d2 in place of m_i, l_ij, det: squared Mahalanobis distance by forward substitution."""
    for i in range(P):
        rest = F.col(T[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        df = df.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    df = df.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0")))
    return df.drop("det", *(f"y{i}" for i in range(P)), *(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i in range(P) for j in range(i + 1)))


def _starts(rows: DataFrame) -> DataFrame:
    """g, start and an estimate: robust scales; spatial signs about the median; two random subsets."""
    norm = F.greatest(sum((F.col(t) * F.col(t) for t in T[1:]), F.col("t0") * F.col("t0")), F.lit(1e-12))
    signs = [F.avg(F.col(T[i]) * F.col(T[j]) * P / norm).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)]
    centre = [F.lit(0.0).alias(f"m{i}") for i in range(P)]
    both = rows.groupBy("g").agg(F.lit(SHARE).alias("rho"), *signs)
    signed = _factor(both.select("g", F.lit(1).alias("start"), "rho", *centre, *(f"c{i}{j}" for i in range(P) for j in range(i + 1))), 1.0)
    plain = _factor(both.select("g", F.lit(0).alias("start"), F.lit(1.0).alias("rho"), *centre, *(F.lit(0.0).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1))), 1.0)
    # a ranked window's limit applies before the shuffle
    at = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("rk", "doc_id"), "rk"))
    chosen = rows.withColumn("at", at).where(F.col("at") <= 2 * SUBSET).withColumn("start", (2 + (F.col("at") - 1) / SUBSET).cast("int"))
    return plain.unionByName(signed).unionByName(_estimates(chosen, 1.0, "g", "start"))


def _concentrate(rows: DataFrame, estimate: DataFrame, few: bool, *keys: str) -> DataFrame:
    """One concentration step for each start: moments of the nearest half of its group."""
    far = _distance(_meet(rows, estimate, few))
    half = far.groupBy(*keys).agg(F.percentile_approx("d2", 0.5, 10000).alias("half"))
    if few:
        near = far.join(F.broadcast(half), [*keys])
    else:
        near = far.join(half.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "salt"])
    return _estimates(near.where(F.col("d2") <= F.col("half")), consistency(0.5), *keys)


def _mcd(rows: DataFrame, few: bool, steps: int, tolerance: float = 1e-3) -> DataFrame:
    """The estimate of each group: the best start's after ``steps`` concentration steps at most, reweighted."""
    return _reweighted(rows, _concentrated(rows, few, steps, tolerance), few)


def _concentrated(rows: DataFrame, few: bool, steps: int, tolerance: float = 1e-3) -> DataFrame:
    starts = materialise(_starts(rows), "starts")
    for _ in range(2):
        starts = materialise(_concentrate(rows, starts, few, "g", "start"), "starts")
    best = starts.groupBy("g").agg(F.min_by(F.struct(*(c for c in starts.columns if c not in ("g", "start"))), F.struct("det", "start")).alias("e")).select("g", "e.*")
    estimate = materialise(best, "estimate")
    for _ in range(steps - 2):
        # the determinant comes along, so that the fall is known without a join
        new = materialise(_concentrate(rows, estimate, few, "g"), "estimate")
        fall = new.select("g", F.col("det").alias("new")).join(estimate.select("g", "det"), "g").agg(F.max(F.col("det") - F.col("new"))).first()[0]
        estimate = new
        if fall is None or fall < tolerance:
            break
    return estimate


def _reweighted(rows: DataFrame, estimate: DataFrame, few: bool) -> DataFrame:
    inner = chi2_point(0.975, P)
    near = _distance(_meet(rows, estimate, few)).where(F.col("d2") <= inner)
    return materialise(_estimates(near, consistency(0.975), "g"), "reweighted")


def judge(docs: DataFrame, confidence: float = 0.999, steps: int = 12) -> DataFrame:
    """Per document: doc_id, rk, the statistics, base_failed, d2 (null if base_failed), kept.

    kept: passes the base rules and its squared distance from its group's estimate is at most the
    ``confidence`` point of a chi-squared distribution of five degrees.  A group is a language and a
    source (null is a value), and is judged by itself however small: the less rows it has the more
    its scatter is the identity in robust units.  Extra columns do not matter; repeated rows count
    each.  Quantiles are Spark's approximate ones; ``steps`` bounds the concentration steps.
    """
    stats = add_stats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").alias("__lang"), F.col("source").alias("__source")).withColumn("rk", row_key()))
    stats = materialise(stats.drop("text").withColumn("base_failed", base_failed()), "stats")
    group = F.xxhash64("__lang", F.col("__lang").isNull(), "__source", F.col("__source").isNull())
    passed = stats.where(~F.col("base_failed")).withColumns({"g": group, "salt": F.pmod(F.xxhash64("doc_id", "rk"), F.lit(SALTS)).cast("int")})
    few = passed.select("g").distinct().count() <= GROUPS
    rows = materialise(_transformed(passed, few), "features")
    far = _distance(_meet(rows, _mcd(rows, few, steps), few))
    verdict = same(stats, far.groupBy("doc_id", "rk").agg(F.max("d2").alias("d2")))
    limit = chi2_point(confidence, P)
    return verdict.select("doc_id", "rk", *STATS, "base_failed", "d2", (~F.col("base_failed") & F.coalesce(F.col("d2") <= limit, F.lit(False))).alias("kept"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that ``judge`` keeps, with all their own columns; repeats of a row stay or go together."""
    return only(docs, judge(docs, **options).where("kept").select("doc_id", "rk").dropDuplicates())
