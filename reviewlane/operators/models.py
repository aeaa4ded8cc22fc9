"""Logistic models fitted in Spark: design, fit, many members at once, prediction.

A design turns a row's fields into numbers: each numeric field with the training median in
place of what is missing and a mark that it was, each category of the training rows that is
frequent enough, and one column for all others. A fit minimises the log loss with an L2 penalty
on standardised columns by Newton's method. What one step needs - loss, gradient and Hessian -
are sums over rows; each task adds up its own, and the driver gets one number for each entry.
Members share the products of a row's columns: these are made once a row, in columns centred
and scaled alike for all, and each member's sums are turned to its own means and scales after.

Several members (folds, resampled ensembles) are fitted by the same passes: a row has a weight
for each member. Designs are fitted on all training rows, means and scales for each member.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlane.functions.materialize import attach, checkpoint
from reviewlane.functions.ranking import percentiles, running_total
from reviewlane.functions.records import finite, logit
from reviewlane.operators.inference import weight

# Rows that a fit needs, rows that a category needs, the name of all rarer ones.
LEAST_ROWS, LEAST_OF_CATEGORY, RARE = 20, 5, "__rare__"
MOST_LEVELS = 1000  # columns of one category; a design is meant to be narrow
STEPS, EXACT = 50, 1e-10
SHARED_ROWS = 1024  # whose products of columns are held at once


@dataclass(frozen=True)
class Design:
    """Fields and what was learnt of them; `columns` names the entries of `features`."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    medians: dict[str, float] = field(default_factory=dict)
    levels: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        marked = [c for name in self.numeric for c in (name, f"{name}__missing")]
        return marked + [f"{name}={level}" for name in self.categorical for level in self.levels[name]]

    def features(self) -> Column:
        """array<double>; a category unknown to the design is rare only if it was so in training, else all its columns are 0."""
        cells = []
        for name in self.numeric:
            value = finite(F.col(name).cast("double"))
            cells += [F.coalesce(value, F.lit(self.medians.get(name, 0.0))), value.isNull().cast("double")]
        for name in self.categorical:
            value = _level(name)
            cells += [(value == level).cast("double") for level in self.levels[name]]
        return F.array(*cells) if cells else F.array().cast("array<double>")


def _level(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("unknown"))


def fit_design(rows: DataFrame, numeric: list[str], categorical: list[str] = (), least: int = LEAST_OF_CATEGORY) -> Design:
    """The design of the training rows (O12.4).

    Medians come from counts of values in order, so no field's values are held together. A
    field without any finite value has median 0. Categories with fewer than `least` rows have
    no column of their own; more than MOST_LEVELS columns of one field stop the query.
    """
    medians, levels = {}, {}
    if numeric:
        cells = F.array(*(F.struct(F.lit(n).alias("field"), finite(F.col(n).cast("double")).alias("value")) for n in numeric))
        long = rows.select(F.explode(cells).alias("c")).select("c.*")
        medians = {r["field"]: r["median"] for r in percentiles(long, "value", {"median": 0.5}, ["field"]).collect()}  # a row for each field
    if categorical:
        cells = F.array(*(F.struct(F.lit(n).alias("field"), _level(n).alias("level")) for n in categorical))
        counts = rows.select(F.explode(cells).alias("c")).groupBy("c.field", "c.level").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        kept = counts.limit(len(categorical) * MOST_LEVELS + 1).collect()
        found = {n: sorted(r["level"] for r in kept if r["field"] == n) for n in categorical}
        if len(kept) > len(categorical) * MOST_LEVELS or any(len(x) > MOST_LEVELS for x in found.values()):
            raise ValueError(f"a category has more than {MOST_LEVELS} frequent levels")
        levels = {n: (*x, RARE) for n, x in found.items()}
    return Design(tuple(numeric), tuple(categorical), medians, levels)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)


def summed(rows: DataFrame, size: int, kernel) -> np.ndarray:
    """The sum of kernel(batch), `size` doubles, over all Arrow batches; a task gives one row for each entry."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += kernel(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "x"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():  # `size` rows
        out[r["i"]] = r["x"]
    return out


@dataclass
class Logistic:
    """One member: weights by column for raw features, an intercept, and the share of ones; `degraded` says why only that is used (O12.5)."""

    prior: float
    weights: np.ndarray | None = None
    intercept: float = 0.0
    degraded: str | None = None
    steps: int = 0


def fit(rows: DataFrame, width: int, members: int = 1, penalty: float = 1.0, least_rows: int = LEAST_ROWS) -> list[Logistic]:
    """Members fitted on rows (x: array<double> of `width`, y: 0 or 1, w: array<double> of `members`).

    A member with fewer than least_rows rows (by weight), without both classes or without
    columns is degraded to its share of ones. Steps that do not lessen a member's loss are halved.
    """
    rows = checkpoint(rows.select("x", F.col("y").cast("double").alias("y"), F.col("w").cast("array<double>").alias("w")))
    d, m = width, members

    def moments(batch):
        x, y, w = _matrix(batch.column("x"), d) if d else np.zeros((batch.num_rows, 0)), batch.column("y").to_numpy(), _matrix(batch.column("w"), m)
        return np.concatenate([w.sum(0), w.T @ y, (w.T @ x).ravel(), (w.T @ (x * x)).ravel()])

    found = summed(rows, m * (2 + 2 * d), moments)
    n, ones = found[:m], found[m : 2 * m]
    safe = np.maximum(n, 1e-300)[:, None]
    mean, square = found[2 * m :].reshape(2, m, d) / safe
    scale = np.sqrt(np.maximum(square - mean**2, 0.0))
    scale = np.where(scale > 1e-9 * np.maximum(1.0, np.abs(mean)), scale, 1.0)
    out = [Logistic(float(ones[k] / n[k]) if n[k] else 0.5) for k in range(m)]
    usable = [k for k in range(m) if d and n[k] >= least_rows and 0 < ones[k] < n[k]]
    for k in set(range(m)) - set(usable):
        out[k].degraded = "TOO_FEW_SAMPLES_OR_COLUMNS"
    if not usable:
        return out

    e, ridge = d + 1, np.diag([penalty] * d + [0.0])
    beta, step = np.zeros((m, e)), np.zeros((m, e))
    best, open_ = np.full(m, np.inf), list(usable)
    # turn[k] takes the shared columns, with an intercept, to the member's own.
    centre, spread = mean[usable].mean(0), scale[usable].mean(0)
    turn = np.zeros((m, e, e))
    turn[:, range(d), range(d)], turn[:, :d, d], turn[:, d, d] = spread / scale, (centre - mean) / scale, 1.0
    upper = np.triu_indices(e)
    for _ in range(STEPS):
        slopes = np.stack([beta[k] @ turn[k] for k in open_], axis=1)

        def newton(batch, open_=tuple(open_), slopes=slopes):
            every = _matrix(batch.column("x"), d), batch.column("y").to_numpy(), _matrix(batch.column("w"), m)[:, open_]
            total = np.zeros((1 + e + len(upper[0]), len(open_)))
            for at in range(0, batch.num_rows, SHARED_ROWS):
                x, y, w = (part[at : at + SHARED_ROWS] for part in every)
                u = np.vstack([((x - centre) / spread).T, np.ones(len(x))])
                eta = u.T @ slopes
                small = np.exp(-np.abs(eta))
                p = np.where(eta >= 0, 1.0, small) / (1.0 + small)
                total[0] += (w * (np.maximum(eta, 0.0) + np.log1p(small) - y[:, None] * eta)).sum(0)
                total[1 : 1 + e] += u @ (w * (p - y[:, None]))
                total[1 + e :] += np.concatenate([u[i:] * u[i] for i in range(e)]) @ (w * p * (1 - p))
            return total.T.ravel()

        sums = summed(rows, len(open_) * (1 + e + len(upper[0])), newton).reshape(len(open_), -1)
        still = []
        for k, s in zip(open_, sums):
            out[k].steps += 1
            loss = s[0] + 0.5 * beta[k] @ ridge @ beta[k]
            if loss > best[k] + 1e-9 * abs(best[k]):
                step[k] /= 2
                beta[k] -= step[k]
                still.append(k)
                continue
            best[k] = loss
            shared = np.zeros((e, e))
            shared[upper] = shared.T[upper] = s[1 + e :]
            hessian = turn[k] @ shared @ turn[k].T + ridge
            step[k] = -np.linalg.lstsq(hessian, turn[k] @ s[1 : 1 + e] + ridge @ beta[k], rcond=None)[0]
            beta[k] += step[k]
            if np.abs(step[k]).max() > EXACT * max(1.0, np.abs(beta[k]).max()):
                still.append(k)
        open_ = still
        if not open_:
            break
    for k in usable:
        out[k].weights = beta[k, :d] / scale[k]
        out[k].intercept = float(beta[k, d] - out[k].weights @ mean[k])
    return out


def linear(weights: np.ndarray, intercept: float, x: str = "x") -> Column:
    """The log odds of a row, as an expression."""
    terms = F.zip_with(x, F.array(*(F.lit(float(v)) for v in weights)), lambda a, b: a * b)
    return F.aggregate(terms, F.lit(float(intercept)), lambda s, t: s + t)


def predicted(model: Logistic, x: str = "x") -> Column:
    """The probability of 1: the model's, or its share of ones where it is degraded (O12.5)."""
    if model.weights is None:
        return F.lit(model.prior)
    return 1.0 / (1.0 + F.exp(-linear(model.weights, model.intercept, x)))


def slope_intercept(rows: DataFrame) -> DataFrame:
    """One row: n, slope and intercept of y on the log odds of p, without penalty; null with one class (O12.7).

    Rows are counted by prediction first.
    """
    counts = rows.groupBy("p").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("n1"))
    cells = F.array(F.struct(F.lit(1).alias("y"), F.col("n1").alias("k")), F.struct(F.lit(0).alias("y"), (F.col("n") - F.col("n1")).alias("k")))
    each = counts.select(F.array(logit(F.col("p"))).alias("x"), F.explode(cells).alias("c")).where("c.k > 0")
    model = fit(each.select("x", "c.y", F.array("c.k").alias("w")), 1, penalty=0.0, least_rows=2)[0]
    both = [None, None] if model.weights is None else [float(model.weights[0]), model.intercept]
    total = rows.agg(F.count("*").alias("n"))
    return total.select("n", *(F.lit(v).cast("double").alias(c) for c, v in zip(("slope", "intercept"), both)))


def _named(group: str) -> Column:
    """A group as text; null is a group of its own."""
    return F.coalesce(F.col(group).cast("string"), F.lit("None"))


def fold_of_groups(rows: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """group (as text), fold: the largest groups go first, each to the fold with the fewest rows so far, lower numbers first (O12.8).

    Groups of one size go in the order of their text. Only the sizes and how many groups have
    each reach the driver (at most the square root of twice the rows); a group finds its fold by
    its place among the groups of its size.
    """
    sizes = checkpoint(rows.groupBy(_named(group).alias("group")).agg(F.count("*").alias("size"))).withColumn("one", F.lit(1).cast("long"))
    placed = running_total(sizes, ["size"], ["group"], "one", "place")
    loads, plan = [0] * folds, []
    for r in sizes.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).toLocalIterator():
        plan += [(r["size"], *phase) for phase in deal(loads, r["size"], r["n"])]
    phases = rows.sparkSession.createDataFrame(plan, "size long, start long, end long, turn array<int>")
    here = (F.col("place") >= F.col("start")) & (F.col("place") < F.col("end"))
    fold = F.get("turn", ((F.col("place") - F.col("start")) % F.size("turn")).cast("int"))
    return placed.join(F.broadcast(phases), "size").where(here).select(F.col("group").alias(group), fold.alias("fold"))


def deal(loads: list[int], size: int, n: int) -> list[tuple[int, int, list[int]]]:
    """(start, end, turn): from which place to which the n groups of one size go round the folds in `turn`; loads are brought up to date.

    The folds within one size of the least loaded take one group each in every round, until
    the rounds reach the next fold's load.
    """
    phases, place = [], 0
    while place < n:
        least = min(loads)
        turn = sorted((f for f in range(len(loads)) if loads[f] < least + size), key=lambda f: (loads[f], f))
        ahead = [x for x in loads if x >= least + size]
        most = (min(ahead) - least) // size * len(turn) if ahead else n
        taken = min(n - place, most)
        phases.append((place, place + taken, turn))
        for i, f in enumerate(turn):
            loads[f] += size * (taken // len(turn) + (i < taken % len(turn)))
        place += taken
    return phases


def out_of_fold(rows: DataFrame, x: str, y: str, group: str, key: str, width: int, folds: int = 5) -> DataFrame:
    """key, fold, p: each row scored by the member that did not see its group (O12.8); all folds are fitted by the same passes.

    Fewer groups than folds give fewer folds, and a single group no scores.
    """
    few = rows.select(_named(group)).distinct().limit(folds).count()
    if few < 2:
        return rows.select(key, F.lit(None).cast("int").alias("fold"), F.lit(None).cast("double").alias("p"))
    named = rows.select(key, F.col(x).alias("x"), F.col(y).alias("y"), _named(group).alias(group))
    held = checkpoint(attach(named, fold_of_groups(rows, group, few), [group]))
    weights = F.array(*((F.col("fold") != k).cast("double") for k in range(few)))
    models = fit(held.select("x", "y", weights.alias("w")), width, few)
    p = F.lit(None).cast("double")
    for k, model in enumerate(models):
        p = F.when(F.col("fold") == k, predicted(model)).otherwise(p)
    return held.select(key, "fold", p.alias("p"))


def ensemble(rows: DataFrame, scored: DataFrame, x: str, y: str, group: str, key: str, width: int, members: int = 20, seed: int = 42) -> DataFrame:
    """key, members, mean, spread of the members' predictions for the scored rows (O12.10).

    Each member is fitted on groups drawn with replacement: a group has a Poisson(1) weight for
    each member. Members without both classes are left out.
    """
    drawn = F.array(*(weight(F.col(group), F.lit(k), seed).cast("double") for k in range(members)))
    models = fit(rows.select(F.col(x).alias("x"), F.col(y).alias("y"), drawn.alias("w")), width, members)
    valid = [m for m in models if m.weights is not None]
    each = scored.select(key, F.col(x).alias("x"))
    if not valid:
        nothing = F.lit(None).cast("double")
        return each.select(key, F.lit(0).alias("members"), nothing.alias("mean"), nothing.alias("spread"))
    slopes, intercepts = np.stack([m.weights for m in valid], axis=1), np.array([m.intercept for m in valid])

    def meant(batches):
        for batch in batches:
            odds = _matrix(batch.column("x"), width) @ slopes + intercepts
            p = 1.0 / (1.0 + np.exp(-np.clip(odds, -700, 700)))
            columns = [batch.column(key), pa.array(np.full(len(p), len(valid), np.int32)), pa.array(p.mean(1)), pa.array(p.std(1))]
            yield pa.RecordBatch.from_arrays(columns, [key, "members", "mean", "spread"])

    nothing = F.lit(0.0)
    return each.mapInArrow(meant, each.select(key, F.lit(0).alias("members"), nothing.alias("mean"), nothing.alias("spread")).schema)
