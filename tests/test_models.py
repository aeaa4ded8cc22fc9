"""Fits, folds, ensembles and calibrators against NumPy on one machine."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlane.operators import calibration, models


def newton(x, y, w, penalty):
    """Weights of raw columns and intercept of the penalised fit on standardised columns."""
    n = w.sum()
    mean = w @ x / n
    scale = np.sqrt(w @ (x - mean) ** 2 / n)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    ridge, b = np.diag([penalty] * x.shape[1] + [0.0]), np.zeros(x.shape[1] + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (p - y)) + ridge @ b)
    return b[:-1] / scale, b[-1] - (b[:-1] / scale) @ mean


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    out = []
    for i in range(400):
        a, b = rng.gauss(3, 2), rng.choice([None, float("nan"), rng.gauss(0, 1), float("inf")])
        kind = rng.choice(["x", "x", "y", None, f"rare{i % 97}"])
        y = int(rng.random() < 1 / (1 + np.exp(-(a - 3 + (kind == "y")))))
        out.append((i, a, b, kind, 7.0, y, f"g{rng.randrange(30)}" if i % 3 else "hot"))
    return out, spark.createDataFrame(out, "id long, a double, b double, kind string, same double, y int, grp string").repartition(5)


def test_design_and_fit(rows):
    plain, frame = rows
    design = models.fit_design(frame, ["a", "b", "same"], ["kind"])
    b = sorted(r[2] for r in plain if r[2] is not None and np.isfinite(r[2]))
    assert design.medians["b"] == pytest.approx(np.median(b)) and design.medians["same"] == 7.0
    assert design.levels["kind"] == ("unknown", "x", "y", "__rare__")
    assert design.columns[:4] == ["a", "a__missing", "b", "b__missing"] and len(design.columns) == 10
    got = {r.id: r.x for r in frame.select("id", design.features().alias("x")).collect()}
    want = np.array([[r[1], 0, r[2] if r[2] is not None and np.isfinite(r[2]) else np.median(b), float(r[2] is None or not np.isfinite(r[2])), 7, 0, r[3] is None, r[3] == "x", r[3] == "y", False] for r in plain], float)
    assert np.allclose([got[r[0]] for r in plain], want)
    y, w = np.array([r[5] for r in plain], float), np.array([1.0 + r[0] % 3 for r in plain])
    two = F.array(F.lit(1.0), 1.0 + F.col("id") % 3)
    found = models.fit(frame.select(design.features().alias("x"), "y", two.alias("w")), 10, 2)
    for model, weights in zip(found, (np.ones(len(y)), w)):
        coefficients, intercept = newton(want, y, weights, 1.0)
        assert np.allclose(model.weights, coefficients, atol=1e-7) and model.intercept == pytest.approx(intercept, abs=1e-7)
        assert model.degraded is None
    p = {r.id: r.p for r in frame.withColumn("x", design.features()).select("id", models.predicted(found[0]).alias("p")).collect()}
    assert np.allclose([p[r[0]] for r in plain], 1 / (1 + np.exp(-(want @ found[0].weights + found[0].intercept))))


def test_degraded_fits_use_the_prior(spark):
    some = spark.createDataFrame([([float(i)], i % 2, [1.0, 0.0, float(i % 2)]) for i in range(30)], "x array<double>, y int, w array<double>")
    found = models.fit(some, 1, 3)
    assert [m.degraded for m in found] == [None, "TOO_FEW_SAMPLES_OR_COLUMNS", "TOO_FEW_SAMPLES_OR_COLUMNS"]
    assert [m.prior for m in found] == [0.5, 0.5, 1.0]
    assert models.fit(some.limit(12), 1, 3)[0].degraded and models.fit(some.limit(0), 1, 3)[0].prior == 0.5
    none = models.fit_design(some.limit(0).withColumn("v", F.lit(1.0)), ["v"], [])
    assert none.medians.get("v", 0.0) == 0.0


def test_slope_and_intercept(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(0.01, 0.99, 300).round(2)
    y = (rng.random(300) < p**2).astype(int)
    frame = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
    row = models.slope_intercept(frame).first()
    (slope,), intercept = newton(np.log(p / (1 - p))[:, None], y.astype(float), np.ones(300), 0.0)
    assert (row.n, row.slope, row.intercept) == (300, pytest.approx(slope, abs=1e-6), pytest.approx(intercept, abs=1e-6))
    assert models.slope_intercept(frame.where("y = 1")).first().slope is None


def greedy(sizes, folds):
    loads, out = [0] * folds, {}
    for group, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        f = loads.index(min(loads))
        out[group], loads[f] = f, loads[f] + n
    return out


@pytest.mark.parametrize("sizes", [
    {f"g{i:03}": 1 + (i * 7) % 5 for i in range(60)}, {"big": 100, **{f"s{i}": 1 for i in range(250)}}, {f"e{i}": 3 for i in range(11)}, {"a": 9, "b": 8, "c": 1, "d": 1}, {"only": 4, "other": 4},
])
def test_folds_follow_the_greedy_rule(spark, sizes):
    frame = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "grp string")
    for folds in (2, 5):
        assert {r.grp: r.fold for r in models.fold_of_groups(frame, "grp", folds).collect()} == greedy(sizes, folds)


def test_out_of_fold_scores_see_no_group_twice(rows):
    plain, frame = rows
    featured = frame.where("grp is not null").select("id", "y", "grp", F.array("a").alias("x"))
    got = {r.id: r for r in models.out_of_fold(featured, "x", "y", "grp", "id", 1, 4).collect()}
    assert len(got) == len(plain)
    fold_of = {r[6]: got[r[0]].fold for r in plain}
    assert all(got[r[0]].fold == fold_of[r[6]] for r in plain) and set(fold_of.values()) == {0, 1, 2, 3}
    x, y, fold = (np.array(v, float) for v in ([r[1] for r in plain], [r[5] for r in plain], [got[r[0]].fold for r in plain]))
    for k in range(4):
        weights, intercept = newton(x[:, None], y, (fold != k).astype(float), 1.0)
        at = fold == k
        assert np.allclose([got[r[0]].p for r, here in zip(plain, at) if here], 1 / (1 + np.exp(-(x[at] * weights[0] + intercept))), atol=1e-7)
    one = featured.withColumn("grp", F.lit("same"))
    assert all(r.p is None for r in models.out_of_fold(one, "x", "y", "grp", "id", 1).collect())


def test_ensemble(rows):
    from reviewlane.operators.inference import weight

    plain, frame = rows
    featured = frame.select("id", "y", "grp", F.array("a").alias("x"))
    got = {r.id: r for r in models.ensemble(featured, featured, "x", "y", "grp", "id", 1, members=6).collect()}
    copies = {r.id: r.w for r in featured.select("id", F.array(*(weight(F.col("grp"), F.lit(k), 42) for k in range(6))).alias("w")).collect()}
    x, y, w = np.array([r[1] for r in plain]), np.array([r[5] for r in plain], float), np.array([copies[r[0]] for r in plain], float)
    p = []
    for k in range(6):
        weights, intercept = newton(x[:, None], y, w[:, k], 1.0)
        p.append(1 / (1 + np.exp(-(x * weights[0] + intercept))))
    assert np.allclose([got[r[0]].mean for r in plain], np.mean(p, 0), atol=1e-7)
    assert np.allclose([got[r[0]].spread for r in plain], np.std(p, 0), atol=1e-7)
    assert got[0].members == 6


def pava(p, y):
    values = sorted(set(p))
    blocks = []
    for v in values:
        blocks.append([v, v, sum(1 for a in p if a == v), sum(b for a, b in zip(p, y) if a == v)])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    return [tuple(b) for b in blocks]


@pytest.mark.parametrize("kind", ["mixed", "rising", "falling", "ties"])
def test_isotonic(spark, kind, monkeypatch):
    monkeypatch.setattr(calibration, "TOGETHER", 2)
    rng = random.Random(3)
    p = {"mixed": [rng.random() for _ in range(500)], "ties": [rng.randrange(7) / 7 for _ in range(500)]}.get(kind, [i / 500 for i in range(500)])
    y = [{"rising": int(v > 0.5), "falling": int(v < 0.5)}.get(kind, int(rng.random() < v)) for v in p]
    frame = spark.createDataFrame([*zip(p, y), (None, 1), (0.5, None)], "p double, y int")
    assert sorted(tuple(r) for r in calibration.isotonic_blocks(frame).collect()) == pava(p, y)
    blocks = pava(p, y)
    asked = [0.0, 1.0, 0.123, 0.5, p[3], None, -4.0]
    x = [e for b in blocks for e in b[:2]]
    want = np.clip(np.interp([a or 0.0 for a in asked], x, [b[3] / b[2] for b in blocks for _ in range(2)]), 1e-6, 1 - 1e-6)
    out = calibration.fit(frame).apply(spark.createDataFrame([(a,) for a in asked], "p double"), "p", "q").collect()
    assert all(r.q is None if r.p is None else r.q == pytest.approx(w) for r, w in zip(out, want))


def test_temperature(spark):
    rng = np.random.default_rng(5)
    p = rng.uniform(0.02, 0.98, 150)
    y = (rng.random(150) < 1 / (1 + np.exp(-(np.log(p / (1 - p)) / 2 + 0.5)))).astype(int)
    frame = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
    found = calibration.fit(frame)
    z = np.log(p / (1 - p))
    loss = {(t, b): -np.mean(np.where(y == 1, np.log(s), np.log(1 - s))) for t in np.linspace(0.25, 4, 76) for b in np.linspace(-2, 2, 81) for s in [1 / (1 + np.exp(-(z / t + b)))]}
    assert (found.temperature, found.bias) == min(loss, key=loss.get)
    assert found.log_loss == pytest.approx(min(loss.values()))
    row = found.apply(frame.limit(1), "p", "q").first()
    assert row.q == pytest.approx(1 / (1 + np.exp(-(np.log(row.p / (1 - row.p)) / found.temperature + found.bias))))
    assert calibration.fit(frame.limit(0)).temperature == 1.0


def test_members_fitted_together_equal_members_alone(spark):
    """Members share the products of columns, also where a column is constant or far away in one of them."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(2500):
        a, b = rng.normal() + 1e4 * (i % 2), float(i % 2) * rng.normal()
        rows.append(([a, b, 3.0], int(rng.random() < 1 / (1 + math.exp(-(a - 1e4 * (i % 2)) - b))), [float(i % 2 == 0), float(i % 2), float(rng.poisson(1.0))]))
    frame = spark.createDataFrame(rows, "x array<double>, y int, w array<double>").coalesce(1)
    together = models.fit(frame, 3, 3)
    for k, model in enumerate(together):
        alone = models.fit(frame.select("x", "y", F.array(F.col("w")[k]).alias("w")), 3)[0]
        assert np.allclose(model.weights, alone.weights, rtol=1e-6, atol=1e-8) and math.isclose(model.intercept, alone.intercept, rel_tol=1e-6, abs_tol=1e-6)
        assert model.degraded is None and abs(model.weights[2]) < 1e-8
