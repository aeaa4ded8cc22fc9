"""Exact bounds against binomial tails, and rates of clustered rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlane.operators import inference, metrics, rates


def test_gamma_and_beta(spark):
    x = [0.01, 0.5, 1.0, 2.5, 17.0, 300.25, 1e6]
    got = [r.g for r in spark.createDataFrame([(v,) for v in x], "x double").select(rates.log_gamma(F.col("x")).alias("g")).collect()]
    assert np.allclose(got, [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-10)
    cases = [(0.3, 2.5, 4.5), (0.9, 12.0, 3.0), (0.5, 1.0, 1.0), (0.02, 0.7, 90.0), (0.4, 700.5, 1100.5)]
    found = spark.createDataFrame(cases, "x double, a double, b double").select("x", "a", "b", rates.beta_cdf(F.col("x"), F.col("a"), F.col("b")).alias("p")).collect()
    for r in found:
        log_beta = math.lgamma(r.a) + math.lgamma(r.b) - math.lgamma(r.a + r.b)
        s = max(1.0, 1 / r.a)  # t = x v^s takes the pole at 0 away
        v = (np.arange(400_000) + 0.5) / 400_000
        t = r.x * v**s
        area = np.mean(np.exp((r.a - 1) * np.log(t) + (r.b - 1) * np.log1p(-t) - log_beta) * r.x * s * v ** (s - 1))
        assert r.p == pytest.approx(area, abs=1e-6)


def test_bounds(spark):
    cases = [(224, 289), (32, 68), (3, 3), (22, 24), (0, 5), (1, 1), (0, 0), (7, 5), (-1, 5), (150_000, 400_000)]
    out = {(r.k, r.n): r for r in rates.with_bounds(spark.createDataFrame(cases, "k long, n long"), 0.7).collect()}
    assert round(out[224, 289].lower, 4) == 0.7309 and round(out[32, 68].lower, 4) == 0.3662
    for k, n in cases[:6]:
        assert out[k, n].lower == pytest.approx(metrics.rate_lower_bound(k, n), abs=1e-9)
        assert out[k, n].upper == pytest.approx(metrics.rate_upper_bound(k, n), abs=1e-9)
    assert all(out[c].lower is None and out[c].upper is None for c in cases[6:9]) and out[0, 0].verdict == "NOT_MEASURABLE"
    large = out[150_000, 400_000]
    assert large.lower == pytest.approx(0.375 - 1.644854 * math.sqrt(0.375 * 0.625 / 400_000), abs=1e-5)
    assert (out[224, 289].verdict, out[32, 68].verdict, out[3, 3].verdict) == ("PASSED", "FAILED", "NOT_ESTABLISHED")


def test_rates_by_threshold(spark):
    rng = np.random.default_rng(1)
    rows = [(float(s), bool(h), m) for s, h, m in zip(rng.integers(0, 11, 300) / 10, rng.random(300) < 0.4, rng.choice(["a", "b"], 300))]
    frame = spark.createDataFrame(rows, "score double, hit boolean, mode string")
    got = {(r.threshold, r.mode): (r.n, r.k) for r in rates.by_threshold(frame, "score", "hit", [0.9, 0.2, 0.5], ["mode"]).collect()}
    assert got == {(t, m): (sum(s >= t and x == m for s, _, x in rows), sum(s >= t and h and x == m for s, h, x in rows)) for t in (0.2, 0.5, 0.9) for m in "ab"}


def test_cluster_corrected_rates(spark):
    rng = np.random.default_rng(6)
    shared = rng.random(40)
    rows = [(f"g{g}", int(rng.random() < shared[g])) for g in range(40) for _ in range(1 + g % 7)]
    frame = spark.createDataFrame(rows, "g string, hit int").repartition(4)
    r = rates.cluster_corrected(frame, "hit", "g", 0.4, 300, (1, 2)).first()
    lows = []
    for seed in (1, 2):
        k, n = np.zeros(300), np.zeros(300)
        for g, hit in rows:
            w = inference.draw_weights(g, 300, seed)
            k, n = k + w * hit, n + w
        lows.append(np.percentile((k / n)[n > 0], [5, 2.5, 97.5]))
    assert (r.lower, r.largest_lower) == (pytest.approx(min(x[0] for x in lows)), pytest.approx(max(x[0] for x in lows)))
    assert (r.low, r.high) == (pytest.approx(min(x[1] for x in lows)), pytest.approx(max(x[2] for x in lows)))
    assert r.rate == pytest.approx(sum(h for _, h in rows) / len(rows)) and r.design_effect > 1
    assert r.effective_lower < metrics.rate_lower_bound(r.k, r.n) and r.clears == (r.lower >= 0.4)
    one = rates.cluster_corrected(frame.where("g = 'g6'"), "hit", "g", 0.4, 30, (1,)).first()
    assert not one.measurable and one.lower is None
    assert not rates.cluster_corrected(frame.limit(0), "hit", "g", 0.4, 30, (1,)).first().measurable
