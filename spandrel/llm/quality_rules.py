"""Quality rules [native]: fixed rules, then robust multivariate outliers by the minimum covariance determinant (MCD).

Six statistics of each text are transformed to a vector.  For each (lang, source) the MCD location and scatter come
from concentration steps: distances under the current estimate, the `SHARE` of the rows with the smallest distances, a
new mean and covariance from them, again for `STEPS` rounds and two starts (median with absolute deviations; mean with
covariance); the start with the smaller determinant wins.  A row is rejected when its squared Mahalanobis distance
under the consistent scatter exceeds the chi-square quantile `CUTOFF`.

All of it is DataFrame expressions: per-row array functions, mergeable aggregates (covariances, approximate quantiles)
and a Cholesky factor written out in columns.  A group is a few numbers, joined back by a plain join that adaptive
execution broadcasts or splits by measured size.

Groups with fewer than `min_group` rows are pooled by language, and pooled over all languages if that is not enough; what
is then still smaller is not tested for outliers.  That bound is the statistical minimum, a few rows for each of the
numbers that a location and a scatter of P statistics have in a direction, and does not change with the input.

Defined results: null or empty texts have no words, so they fail the rules; null lang or source are values of their
own; repeated rows count each; a null doc_id is passed on; of equal distances all are taken or none; a very long text
is one row's arrays; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table, text_words

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Share of a group's rows that the estimate rests on, rounds, and the probability below which distances are accepted.
SHARE, STEPS, CUTOFF = 0.75, 5, 1 - 1e-5
#: Rows that an estimate needs at least: five for each of P + 1.
MIN_GROUP = 35
#: Added to the variances: differences of that size in a transformed statistic are no evidence.  Those of repeated words
#: and duplicate lines are small enough that shares of nearly a half exceed the cutoff alone where a group has none.
FLOOR = (0.15, 0.08, 0.25, 0.25, 0.25, 0.25)
P = len(FLOOR)


def _chi2_cdf(x: float, df: int) -> float:
    """Regularised lower incomplete gamma, by its series."""
    a, x = df / 2, x / 2
    term = total = 1 / a
    for n in range(1, 2000):
        term *= x / (a + n)
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a))) if x > 0 else 0.0


def chi2_quantile(p: float, df: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def consistency(share: float, df: int) -> float:
    """Factor that makes the covariance of the central `share` of normal rows that of all rows."""
    return share / _chi2_cdf(chi2_quantile(share, df), df + 2)


def _without(c: str, chars: str) -> Column:
    return F.length(F.translate(c, chars, ""))


def text_statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper and n_lines to doc_id, lang and source."""
    d = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("t"))
    d = d.withColumn("w", text_words(F.col("t"))).withColumn("n", F.size("w"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    d = d.withColumn("lines", lines)
    gram = F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")))
    d = d.withColumn("g", F.when(F.col("n") >= 3, F.sort_array(gram)))
    same = lambda k, x: F.coalesce(F.get("g", k)["h"] == x["h"], F.lit(False))
    d = d.withColumn("twice", F.filter("g", lambda x, k: same(k - 1, x) | same(k + 1, x)))
    covered = F.array_distinct(F.flatten(F.transform("twice", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    length = F.length("t")
    return d.select(
        "doc_id", "lang", "source",
        F.col("n").cast("long").alias("n_words"),
        _without("t", " \t\n\x0b\f\r").cast("long").alias("word_chars"),
        (length - _without("t", SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("twice") > 0, F.size(covered)).otherwise(0).cast("long").alias("n_repeat_words"),
        (length - _without("t", UPPER)).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def _vector() -> list[Column]:
    """The transformed statistics, in the order of FLOOR."""
    n, chars, lines = (F.greatest(F.col(c).cast("double"), F.lit(1.0)) for c in ("n_words", "word_chars", "n_lines"))
    return [F.log(n), F.log(chars / n), F.log(0.1 + F.col("n_repeat_words") / n), F.log(0.02 + F.col("n_symbols") / chars), F.log(0.1 + F.col("n_dup_lines") / lines), F.log(0.05 + F.col("n_upper") / chars)]


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i + 1)]


def _factor(est: DataFrame) -> DataFrame:
    """Cholesky factor l_i_j of the covariance s_i_j (floors added), and the logarithm of its determinant."""
    for i, j in [(i, j) for j in range(P) for i in range(j, P)]:
        s = F.col(f"s_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
        est = est.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(s + FLOOR[i] ** 2, F.lit(1e-12))) if i == j else s / F.col(f"l_{j}_{j}"))
    return est.withColumn("log_det", sum((2 * F.log(f"l_{i}_{i}") for i in range(P)), F.lit(0.0)))


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    for i in range(P):
        rest = F.col(f"x_{i}") - F.col(f"m_{i}") - sum((F.col(f"l_{i}_{k}") * F.col(f"y_{k}") for k in range(i)), F.lit(0.0))
        rows = rows.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))
    return rows.withColumn("d2", sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(P)), F.lit(0.0)))


_X = [f"x_{i}" for i in range(P)]


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.avg(x).alias(f"m_{i}") for i, x in enumerate(_X)], *[F.covar_pop(f"x_{i}", f"x_{j}").alias(f"s_{i}_{j}") for i, j in _pairs()])


def _starts(rows: DataFrame) -> DataFrame:
    """Two starts for each group: mean and covariance; median and the scaled median absolute deviation."""
    mean = _moments(rows, ["grp"]).withColumn("start", F.lit(0))
    mid = materialize(rows.groupBy("grp").agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"m_{i}") for i, x in enumerate(_X)]))
    spread = rows.join(mid, "grp").groupBy("grp").agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5, 1000).alias(f"a_{i}") for i, x in enumerate(_X)])
    robust = mid.join(spread, "grp").select("grp", *[f"m_{i}" for i in range(P)], *[(F.pow(1.4826 * F.col(f"a_{i}"), F.lit(2.0)) if i == j else F.lit(0.0)).alias(f"s_{i}_{j}") for i, j in _pairs()], F.lit(1).alias("start"))
    return _factor(mean.unionByName(robust))


def mcd(rows: DataFrame, steps: int = STEPS, share: float = SHARE) -> DataFrame:
    """MCD estimate (m_i, l_i_j) of each grp of rows x_0.., the better of two starts."""
    est = materialize(_starts(rows))
    for _ in range(steps):
        # estimate and limit are one small table, whose size Spark knows, so that the rows needn't move for either
        near = _distance(rows.join(est, "grp"))
        limit = near.groupBy("grp", "start").agg(F.percentile_approx("d2", share, 10_000).alias("limit"))
        bound = materialize(est.join(limit, ["grp", "start"]))
        near = _distance(rows.join(bound, "grp")).where("d2 <= limit")
        est = materialize(_factor(_moments(near, ["grp", "start"])))
    names = [c for c in est.columns if c[:2] in ("m_", "l_")]
    return est.groupBy("grp").agg(F.min_by(F.struct(*names), F.struct("log_det", "start")).alias("e")).select("grp", "e.*")


def quality(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The statistics with base_failed, grp, distance (null if untested) and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = materialize(text_statistics(docs).withColumn("base_failed", failed).withColumns({x: v for x, v in zip(_X, _vector(), strict=True)}))
    name = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(c)))
    stats = stats.withColumns({"kl": name("lang"), "ks": name("source")})
    # where each (lang, source) goes: to itself, its language's rest, or the rest of all
    counts = stats.where("not base_failed").groupBy("kl", "ks").agg(F.count("*").alias("n"))
    small = counts.where(F.col("n") < min_group)
    rest = small.groupBy("kl").agg(F.sum("n").alias("n_rest"))
    grp = F.when(F.col("n") >= min_group, F.concat_ws(" ", "kl", "ks")).when(F.col("n_rest") >= min_group, F.col("kl")).otherwise("all")
    where = materialize(counts.join(rest, "kl", "left").select("kl", "ks", grp.alias("grp")))
    stats = stats.join(where, ["kl", "ks"], "left")
    rows = materialize(stats.where("not base_failed").select("grp", *_X))
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n_group"))
    est = materialize(mcd(rows).join(sizes, "grp"))
    out = _distance(stats.join(est, "grp", "left"))
    distance = F.when(~F.col("base_failed") & (F.col("n_group") >= min_group), F.col("d2") / consistency(SHARE, P))
    out = out.withColumn("distance", distance)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(CUTOFF, P), F.lit(True)))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", "grp")
