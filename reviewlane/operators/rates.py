"""Exact binomial bounds as columns, and rates whose rows come in clusters.

The bounds of a rate are quantiles of beta distributions. Their distribution function is a
continued fraction and its inverse a bisection, both written as expressions, so every group's
bounds are computed where the group is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlane.functions.materialize import checkpoint
from reviewlane.operators.inference import SAMPLE, resampled
from reviewlane.operators.metrics import intraclass

# The level of one-sided bounds, the normal quantile at that level, seeds of resampling.
ALPHA, NORMAL, SEEDS = 0.05, 1.6448536269514722, (42, 43, 44, 45)
HALVINGS = 50
TINY = 1e-300


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x > 0: Stirling's series at x + 10, stepped back."""

    def series(z: Column) -> Column:
        tail = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680.0 * z * z)) / (z * z)) / (z * z)) / z
        return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + tail

    steps = sum((F.log(x + float(i)) for i in range(1, 10)), F.log(x))
    return _bound(x + 10.0, series) - steps


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    safe = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)

    def term(s: Column, t: Column) -> Column:
        return _bound(F.struct((1.0 / safe(1.0 + t * s["d"])).alias("d"), safe(1.0 + t / s["c"]).alias("c")), lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (s["h"] * n["c"] * n["d"]).alias("h")))

    def step(s: Column, i: Column) -> Column:
        m = i.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return _bound(term(s, even), lambda half: term(half, odd))

    first = 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    steps = F.sequence(F.lit(1), (F.lit(60) + F.ceil(4 * F.sqrt(F.greatest(a, b)))).cast("int"))
    return F.aggregate(steps, start, step, lambda s: s["h"])


def beta_cdf(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function at 0 < x < 1."""

    def value(v: Column) -> Column:
        front = F.exp(v["a"] * F.log(v["x"]) + v["b"] * F.log(1.0 - v["x"]) + log_gamma(v["a"] + v["b"]) - log_gamma(v["a"]) - log_gamma(v["b"]))
        part = front * _fraction(v["x"], v["a"], v["b"]) / v["a"]
        return F.when(v["direct"], part).otherwise(1.0 - part)

    direct = x < (a + 1.0) / (a + b + 2.0)  # where the fraction converges fast; elsewhere by symmetry
    sides = F.struct(F.when(direct, x).otherwise(1.0 - x).alias("x"), F.when(direct, a).otherwise(b).alias("a"), F.when(direct, b).otherwise(a).alias("b"), direct.alias("direct"))
    return _bound(sides, value)


def beta_quantile(q: float, a: Column, b: Column) -> Column:
    """Where the distribution function of Beta(a, b) reaches q, by bisection."""

    def halve(s: Column, _: Column) -> Column:
        def at(middle: Column) -> Column:
            below = beta_cdf(middle, a, b) < q
            return _bound(below, lambda low: F.struct(F.when(low, middle).otherwise(s["low"]).alias("low"), F.when(low, s["high"]).otherwise(middle).alias("high")))

        return _bound((s["low"] + s["high"]) / 2.0, at)

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda s: (s["low"] + s["high"]) / 2.0)


def lower_bound(k: Column, n: Column, alpha: float = ALPHA) -> Column:
    """The rate at which k or more of n has probability alpha (O11.13); null unless 0 <= k <= n and n > 0."""
    real = lambda c: c.cast("double")
    inside = beta_quantile(alpha, F.greatest(real(k), F.lit(1e-9)), F.greatest(real(n) - real(k), F.lit(0.0)) + 1.0)
    known = F.when(k == 0, 0.0).when(k == n, F.pow(F.lit(alpha), 1.0 / real(n))).otherwise(inside)
    return F.when((n > 0) & (k >= 0) & (k <= n), known)


def upper_bound(k: Column, n: Column, alpha: float = ALPHA) -> Column:
    return 1.0 - lower_bound(n - k, n, alpha)


def with_bounds(counts: DataFrame, threshold: float, k: str = "k", n: str = "n") -> DataFrame:
    """counts with rate, lower, upper and what they say about the threshold."""
    out = counts.withColumns({"rate": F.col(k) / F.when(F.col(n) > 0, F.col(n)), "lower": lower_bound(F.col(k), F.col(n)), "upper": upper_bound(F.col(k), F.col(n))})
    said = F.when(F.col("rate").isNull(), "NOT_MEASURABLE").when(F.col("lower") >= threshold, "PASSED").when(F.col("upper") < threshold, "FAILED").otherwise("NOT_ESTABLISHED")
    return out.withColumn("verdict", said)


def by_threshold(rows: DataFrame, score: str, hit: str, thresholds: list[float], by: list[str] = ()) -> DataFrame:
    """threshold, by, n and k: rows with at least that score and the hits among them (O6.19, O6.20, O6.27).

    Rows are counted by how many thresholds they meet; a row is not repeated for each.
    """
    met = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in sorted(thresholds)), F.lit(0))
    counts = rows.groupBy(*by, met.alias("met")).agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("long")).alias("k"))
    grid = F.array(*(F.lit(float(t)) for t in sorted(thresholds)))
    spread = counts.where("met > 0").select(*by, "n", "k", F.posexplode(F.slice(grid, F.lit(1), F.col("met"))).alias("i", "threshold"))
    return spread.groupBy("threshold", *by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def cluster_corrected(rows: DataFrame, flag: str, grouping: str, threshold: float, draws: int = 4000, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """One row: the rate of flagged rows with bounds that pay for what rows of one group share (O11.14).

    lower and the two-sided ends come from resampling groups, the least (or largest) of several
    seeds; normal_lower widens the normal bound by the design effect, effective_lower is the
    exact bound at n divided by it. With fewer than two groups nothing is measurable.
    """
    counted = checkpoint(rows.select(F.col(grouping).alias("group"), F.col(flag).cast("long").alias("hit")))
    ends = None
    for seed in seeds:
        drawn = resampled(counted, "group", {"k": F.col("hit"), "n": F.lit(1)}, draws, seed).where(F.col("draw") != SAMPLE)
        one = drawn.agg(F.percentile(F.col("k") / F.col("n"), F.array(*map(F.lit, (ALPHA, ALPHA / 2, 1 - ALPHA / 2)))).alias("q"))
        ends = one if ends is None else ends.unionByName(one)
    ends = ends.agg(F.min(F.col("q")[0]).alias("lower"), F.max(F.col("q")[0]).alias("largest_lower"), F.min(F.col("q")[1]).alias("low"), F.max(F.col("q")[2]).alias("high"))
    layout = intraclass(counted, "group", "hit").select(F.col("k").alias("groups"), "icc", "design_effect")
    whole = counted.agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("k"))
    joined = whole.join(F.broadcast(layout)).join(F.broadcast(ends))  # one row each
    rate, effect = F.col("k") / F.col("n"), F.coalesce(F.nullif(F.col("design_effect"), F.lit(0.0)), F.lit(1.0))
    effective = F.col("n") / effect
    hits = rate * effective
    exact = F.when((hits > 0) & (hits < effective), beta_quantile(ALPHA, F.greatest(hits, F.lit(1e-9)), F.greatest(effective - hits, F.lit(0.0)) + 1.0))
    values = {
        "rate": rate, "icc": F.col("icc"), "design_effect": F.col("design_effect"), "lower": F.col("lower"), "largest_lower": F.col("largest_lower"), "low": F.col("low"), "high": F.col("high"),
        "normal_lower": rate - NORMAL * F.sqrt(rate * (1 - rate) / F.col("n") * F.greatest(effect, F.lit(0.0))), "effective_lower": exact,
    }
    measurable = (F.col("groups") >= 2) & (F.col("n") > 0)
    clears = F.when(measurable, F.col("lower") >= threshold)
    return joined.select(measurable.alias("measurable"), "groups", "n", "k", *(F.when(measurable, v).alias(c) for c, v in values.items()), clears.alias("clears"))
