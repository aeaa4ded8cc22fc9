"""Calibration, discrimination and selective prediction over (p, y) rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlane.functions.ranking import running_total
from reviewlane.functions.records import confidence


def scores(rows: DataFrame) -> DataFrame:
    """One row: n, Brier score and log loss with p kept 1e-6 from its ends (O6.8)."""
    q = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-6)), F.lit(1e-6))
    loss = -(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1.0 - q))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 9).alias("brier"), F.round(F.avg(loss), 9).alias("log_loss"))


def bin_edges(n: int = 10) -> list[float]:
    """Evenly spaced doubles from 0 to 1, each i * (1 / n)."""
    step = 1.0 / n
    return [i * step for i in range(n)] + [1.0]


def reliability(rows: DataFrame, n: int = 10) -> DataFrame:
    """bin, n, mean_p, rate of equal-width bins; the last is closed on the right (O6.10)."""
    edges = bin_edges(n)[1:-1]
    place = sum((F.when(F.col("p") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return rows.groupBy(place.alias("bin")).agg(
        F.count("*").alias("n"), F.round(F.avg("p"), 9).alias("mean_p"), F.round(F.avg(F.col("y").cast("double")), 9).alias("rate")
    )


def calibration_error(rows: DataFrame, n: int = 10) -> DataFrame:
    """One row: the gap of means, weighed by bin size (O6.9)."""
    gap = F.abs(F.col("mean_p") - F.col("rate"))
    return reliability(rows, n).agg(F.round(F.sum(gap * F.col("n")) / F.sum("n"), 6).alias("ece"))


def auc(rows: DataFrame) -> DataFrame:
    """One row: the area under the ROC curve by average ranks; null with one class (O6.11)."""
    # Rows are counted by prediction once; positives of one prediction share its average rank.
    counts = rows.groupBy("p").agg(F.count("*").alias("k"), F.sum(F.col("y").cast("long")).alias("k1"))
    placed = running_total(counts, [], ["p"], "k", "before")
    rank = F.col("before") + (F.col("k") + 1) / 2.0
    s = placed.agg(
        F.sum(F.col("k1") * rank).alias("s"), F.coalesce(F.sum("k1"), F.lit(0)).alias("n1"), F.coalesce(F.sum(F.col("k") - F.col("k1")), F.lit(0)).alias("n0")
    )
    n1, n0 = F.col("n1"), F.col("n0")
    return s.select("n1", "n0", F.when((n1 > 0) & (n0 > 0), F.round((F.col("s") - n1 * (n1 + 1) / 2.0) / (n1 * n0), 9)).alias("auc"))


def thresholds(n: int = 41) -> list[float]:
    return [0.5 + i * 0.0125 for i in range(n)]


def risk_coverage(rows: DataFrame, n: int = 41) -> DataFrame:
    """threshold, kept, errors, coverage, risk: predictions at least as sure as each threshold (O6.12).

    Rows are first counted by the number of thresholds that they meet; the curve is then a
    sum over those few counts, so no row is repeated for each threshold.
    """
    grid = thresholds(n)
    met = sum((F.when(confidence(F.col("p")) >= t, 1).otherwise(0) for t in grid), F.lit(0))
    wrong = ((F.col("p") >= 0.5).cast("int") != F.col("y")).cast("long")
    counts = rows.groupBy(met.alias("met")).agg(F.count("*").alias("k"), F.sum(wrong).alias("e"))
    total = F.sum("k").over(Window.partitionBy())  # n + 1 rows
    spread = counts.withColumn("total", total).select("total", "k", "e", F.explode(F.sequence(F.lit(1), F.col("met"))).alias("i")).where("i > 0")
    edges = F.array(*map(F.lit, grid))
    curve = spread.groupBy("i").agg(F.sum("k").alias("kept"), F.sum("e").alias("errors"), F.max("total").alias("total"))
    return curve.select(
        F.round(F.get(edges, F.col("i") - 1), 6).alias("threshold"),
        "kept",
        "errors",
        F.round(F.col("kept") / F.col("total"), 9).alias("coverage"),
        F.round(F.col("errors") / F.col("kept"), 9).alias("risk"),
    )


def area_under(curve: DataFrame) -> DataFrame:
    """One row: trapezoid area of risk over coverage, divided by the range of coverage (O6.13)."""
    w = Window.orderBy("coverage", F.desc("threshold"))  # one row a threshold
    step = (F.col("coverage") - F.lag("coverage").over(w)) * (F.col("risk") + F.lag("risk").over(w)) / 2.0
    pieces = curve.withColumn("step", step)
    span = F.max("coverage") - F.min("coverage")
    return pieces.agg(F.when(span > 0, F.round(F.sum("step") / span, 6)).alias("aurc"))


def threshold_for_risk(curve: DataFrame, target: float, least_coverage: float = 0.05) -> DataFrame:
    """One row: the lowest threshold that keeps risk and coverage in bounds; null if none does (O11.12)."""
    return curve.where((F.col("risk") <= target) & (F.col("coverage") >= least_coverage)).agg(F.min("threshold").alias("threshold"))


def abstain(p: Column, threshold: float, hard: dict[str, Column], unfamiliar: Column) -> Column:
    """Why a row is not scored, hard reasons first in their order; null if it is scored (O4.15)."""
    out = F.when(unfamiliar, "OUT_OF_DISTRIBUTION").when(confidence(p) < threshold, "LOW_CONFIDENCE")
    for name, state in reversed(list(hard.items())):
        out = F.when(state, name).otherwise(out)
    return out


def intraclass(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row: k groups, n, n0, icc, design_effect of a one-way layout (O6.5); null if it can't be measured."""
    per = rows.groupBy(group).agg(F.count("*").alias("g"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    all_ = per.agg(
        F.count("*").alias("k"),
        F.sum("g").alias("n"),
        F.sum(F.col("g") * F.col("g")).alias("g2"),
        F.sum("s").alias("s"),
        F.sum("ss").alias("ss"),
        F.sum(F.col("s") * F.col("s") / F.col("g")).alias("between"),
    )
    k, n = F.col("k"), F.col("n")
    ms_between = (F.col("between") - F.col("s") * F.col("s") / n) / (k - 1)
    ms_within = (F.col("ss") - F.col("between")) / (n - k)
    n0 = (n - F.col("g2") / n) / (k - 1)
    down = ms_between + (n0 - 1) * ms_within
    icc = F.when(down == 0, 0.0).otherwise((ms_between - ms_within) / down)
    ok = (k >= 2) & (n > k)
    effect = 1 + (n / k - 1) * icc
    return all_.select("k", "n", *(F.when(ok, F.round(x, 6)).alias(name) for x, name in ((n0, "n0"), (icc, "icc"), (effect, "design_effect"))))


def rate_lower_bound(k: int, n: int, alpha: float = 0.05) -> float:
    """One-sided exact binomial bound: the rate at which k or more of n has probability alpha (O11.13)."""
    if n == 0 or k == 0:
        return 0.0
    if k == n:
        return alpha ** (1 / n)

    def tail(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = 0.0, k / n
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if tail(middle) < alpha else (low, middle)
    return low


def rate_upper_bound(k: int, n: int, alpha: float = 0.05) -> float:
    return 1.0 - rate_lower_bound(n - k, n, alpha)


def sign_test(k: int, n: int) -> float:
    """Probability of k or more heads of n fair coins (O11.21)."""
    return sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n


def verdict(low: Column, high: Column, threshold: float, consistent: Column) -> Column:
    """What an interval says about a threshold (O11.2)."""
    return F.when(~consistent, "NOT_MEASURABLE").when(low > threshold, "PASSED").when(high < threshold, "FAILED").otherwise("NOT_ESTABLISHED")
