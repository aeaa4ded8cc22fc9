"""Queries of exact and cluster-corrected rates, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlane.operators import inference, rates
from reviewlane.sources.tables import candidates

THRESHOLD, GRID, DRAWS = 0.5, [0.5, 0.6, 0.7, 0.8, 0.9], 800


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured and vetted rows: sure is how far the score is from undecided, hit whether it agrees with the label."""
    c = candidates(spark, sf_dir).where("prob is not null and label <> 'unknown'")
    hit = (F.col("prob") >= 0.5) == (F.col("label") == "with-signal")
    return c.select("station", "transmitter", "label", F.greatest(F.col("prob"), 1 - F.col("prob")).alias("sure"), hit.cast("int").alias("hit"))


def _rounded(df: DataFrame, *kept: str) -> DataFrame:
    return df.select(*kept, "verdict", *(F.round(c, 6).alias(c) for c in ("rate", "lower", "upper")))


def rate_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _scored(spark, sf_dir).groupBy("transmitter").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("k"))
    return _rounded(rates.with_bounds(counts, THRESHOLD), "transmitter", "n", "k")


def rate_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = rates.by_threshold(_scored(spark, sf_dir), "sure", "hit", GRID, ["label"])
    return _rounded(rates.with_bounds(counts, THRESHOLD), "threshold", "label", "n", "k")


def cluster_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rates.cluster_corrected(_scored(spark, sf_dir), "hit", "station", THRESHOLD, DRAWS)
    names = ["rate", "icc", "design_effect", "lower", "largest_lower", "low", "high", "normal_lower", "effective_lower"]
    return out.select("measurable", "groups", "n", "k", "clears", *(F.round(c, 6).alias(c) for c in names))


QUERIES = {f.__name__: f for f in (rate_bounds, rate_by_threshold, cluster_rate)}


def _bounds(counts: str, keys: str) -> str:
    """Bounds by halving an interval, with the binomial tail summed up term by term."""
    term = "exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(m) + (n - i) * ln(1 - m))"
    side = lambda name, k: f"""{name}(step, {keys}, n, k, low, high) AS (SELECT 0, {keys}, n, {k} AS k, 0::DOUBLE, 1::DOUBLE FROM counts UNION ALL
        SELECT step + 1, {keys}, n, k, CASE WHEN tail < 0.05 THEN m ELSE low END, CASE WHEN tail < 0.05 THEN high ELSE m END FROM (
            SELECT *, (SELECT coalesce(sum({term}), 0) FROM range(0, 100000) r(i) WHERE i >= k AND i <= n) AS tail FROM (SELECT *, (low + high) / 2 AS m FROM {name} WHERE step < 30)))"""  # noqa: E731
    value = lambda name: f"CASE WHEN {name}.k = 0 THEN 0 WHEN {name}.k = {name}.n THEN pow(0.05::DOUBLE, 1::DOUBLE / {name}.n) ELSE ({name}.low + {name}.high) / 2 END"
    same = " AND ".join(f"lo.{k} IS NOT DISTINCT FROM up.{k}" for k in keys.split(", "))
    return f"""counts AS ({counts}), {side("lo", "k")}, {side("up", "n - k")},
        b AS (SELECT {", ".join(f"lo.{k}" for k in keys.split(", "))}, lo.n, lo.k, lo.k::DOUBLE / lo.n AS rate, {value("lo")} AS lower, 1 - {value("up")} AS upper FROM lo JOIN up ON {same} WHERE lo.step = 30 AND up.step = 30)
        SELECT {keys}, n, k, CASE WHEN lower >= {THRESHOLD} THEN 'PASSED' WHEN upper < {THRESHOLD} THEN 'FAILED' ELSE 'NOT_ESTABLISHED' END AS verdict, round(rate, 6) AS rate, round(lower, 6) AS lower, round(upper, 6) AS upper FROM b"""


def oracles(cand: str) -> dict[str, str]:
    """SQL by query name; cand: the registry's common table expression of candidates."""
    rows = cand + """, rated AS (SELECT station, transmitter, label, greatest(prob, 1 - prob) AS sure, CAST((prob >= 0.5) = (label = 'with-signal') AS INT) AS hit
        FROM cand WHERE prob IS NOT NULL AND label <> 'unknown')"""
    copies = " + ".join(f"(v >= '{bar:08x}')::INT" for bar in inference.poisson_bars())
    density = "exp((a - 1) * ln(t) + (b - 1) * ln(1 - t) + lgamma(a + b) - lgamma(a) - lgamma(b))"
    return {
        "rate_bounds": f"WITH RECURSIVE {rows}, {_bounds('SELECT transmitter, count(*) AS n, CAST(sum(hit) AS BIGINT) AS k FROM rated GROUP BY 1', 'transmitter')}",
        "rate_by_threshold": f"""WITH RECURSIVE {rows}, {_bounds(f"SELECT threshold, label, count(*) AS n, CAST(sum(hit) AS BIGINT) AS k FROM rated, (SELECT unnest({GRID}::DOUBLE[]) AS threshold) WHERE sure >= threshold GROUP BY 1, 2", "threshold, label")}""",
        "cluster_rate": f"""WITH RECURSIVE {rows}, g AS (SELECT station AS grp, count(*) AS n, sum(hit) AS k FROM rated GROUP BY 1),
            w AS (SELECT seed, 4 * b + i AS d, sum(n * w) AS n, sum(k * w) AS k FROM (SELECT *, {copies} AS w FROM (SELECT *, substr(h, 1 + 8 * i, 8) AS v FROM (
                SELECT *, md5(seed || ':' || b || ':' || coalesce(CAST(grp AS VARCHAR), '')) AS h FROM g, range(0, {DRAWS // 4}) r(b), (SELECT unnest([42, 43, 44, 45]) AS seed)), range(0::INT, 4::INT) q(i))) WHERE w > 0 GROUP BY ALL),
            s AS (SELECT seed, quantile_cont(k::DOUBLE / n, 0.05::DOUBLE) AS l1, quantile_cont(k::DOUBLE / n, 0.025::DOUBLE) AS l2, quantile_cont(k::DOUBLE / n, 0.975::DOUBLE) AS h2 FROM w GROUP BY seed),
            e AS (SELECT min(l1) AS lower, max(l1) AS largest_lower, min(l2) AS low, max(h2) AS high FROM s),
            t AS (SELECT count(*) AS groups, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, sum(n * n)::DOUBLE AS g2, sum(k * k::DOUBLE / n) AS bt FROM g),
            m AS (SELECT *, (bt - k * k / n) / (groups - 1) AS msb, (k - bt) / (n - groups) AS msw, (n - g2 / n) / (groups - 1) AS n0 FROM t),
            f AS (SELECT *, round((msb - msw) / (msb + (n0 - 1) * msw), 6) AS icc, round(1 + (n / groups - 1) * (msb - msw) / (msb + (n0 - 1) * msw), 6) AS effect FROM m),
            p AS (SELECT *, k / effect AS a, (n - k) / effect + 1 AS b FROM f),
            z(step, a, b, lo, hi) AS (SELECT 0, a, b, 0::DOUBLE, 1::DOUBLE FROM p UNION ALL
                SELECT step + 1, a, b, CASE WHEN area < 0.05 THEN mid ELSE lo END, CASE WHEN area < 0.05 THEN hi ELSE mid END FROM (
                    SELECT *, (SELECT sum({density} * CASE WHEN i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * mid / 12000 FROM (SELECT i, mid * i / 4000::DOUBLE AS t FROM range(1, 4001) r(i))) AS area
                    FROM (SELECT *, (lo + hi) / 2 AS mid FROM z WHERE step < 30)))
            SELECT true AS measurable, groups, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, lower >= {THRESHOLD} AS clears, round(k / n, 6) AS rate, icc, effect AS design_effect, round(lower, 6) AS lower, round(largest_lower, 6) AS largest_lower,
                round(low, 6) AS low, round(high, 6) AS high, round(k / n - {rates.NORMAL} * sqrt(k / n * (1 - k / n) / n * effect), 6) AS normal_lower, round((z.lo + z.hi) / 2, 6) AS effective_lower
            FROM p, e, z WHERE z.step = 30""",
    }
