"""Calibrators of predicted probabilities: isotonic regression and a grid of temperatures (O12.6).

Both work on counts of rows by prediction. Isotonic regression pools adjacent violators: counts
are dealt into partitions in order of prediction, each partition pools its own, and blocks of
neighbouring partitions are pooled together round by round, because pooling blocks of pooled
parts gives the blocks of the whole. For n labels of 0 and 1 there are at most some
3 n^(2/3) blocks, as their means rise strictly and are fractions whose denominators sum to n,
so the last round and the driver hold few rows however many predictions differ.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlane.functions.materialize import checkpoint
from reviewlane.functions.ranking import PART, in_order
from reviewlane.functions.records import logit
from reviewlane.operators.models import summed

# Labels from which on isotonic regression is chosen, how far results stay from 0 and 1, the grid.
LEAST_ISOTONIC, EDGE = 200, 1e-6
TEMPERATURES, BIASES = np.linspace(0.25, 4.0, 76), np.linspace(-2.0, 2.0, 81)
TOGETHER = 16  # neighbouring partitions whose blocks are pooled in one round
BLOCK = "low double, high double, n long, n1 long"


def counted(rows: DataFrame) -> DataFrame:
    """p, n, n1: rows and ones of each prediction; null predictions and labels are left out."""
    known = rows.where("p is not null and y is not null")
    return known.groupBy("p").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("n1"))


def pooled(low, high, n, n1) -> tuple[list, list, list, list]:
    """Blocks in order, neighbours whose means do not rise pooled; exact in whole numbers."""
    stack = []
    for a, b, k, k1 in zip(low, high, n, n1):
        while stack and stack[-1][3] * k >= k1 * stack[-1][2]:
            a, _, more, more1 = stack.pop()
            k, k1 = k + more, k1 + more1
        stack.append((a, b, k, k1))
    return tuple(map(list, zip(*stack))) if stack else ([], [], [], [])


def _pool_parts(blocks: DataFrame) -> DataFrame:
    """The pooled blocks of each PART; a task holds the blocks of its parts only."""

    def run(batches):
        at, held = None, ([], [], [], [])

        def given():
            columns = pooled(*held)
            arrays = [pa.array([at] * len(columns[0]), pa.int32())] + [pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.float64(), pa.int64(), pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, [PART, "low", "high", "n", "n1"])

        for batch in batches:
            for part, *block in zip(*(batch.column(c).to_pylist() for c in (PART, "low", "high", "n", "n1"))):
                if part != at:
                    if at is not None:
                        yield given()
                    at, held = part, ([], [], [], [])
                for column, x in zip(held, block):
                    column.append(x)
        if at is not None:
            yield given()

    return blocks.mapInArrow(run, f"`{PART}` int, {BLOCK}")


def isotonic_blocks(rows: DataFrame) -> DataFrame:
    """low, high, n, n1: the blocks of the isotonic regression of y on p, from the least to the largest prediction in each."""
    dealt = in_order(counted(rows), ["p"]).select(F.col(PART).cast("int").alias(PART), F.col("p").alias("low"), F.col("p").alias("high"), "n", "n1")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = checkpoint(_pool_parts(dealt.sortWithinPartitions(PART, "low")))
    while parts > 1:
        parts = -(-parts // TOGETHER)
        blocks = blocks.withColumn(PART, F.floor(F.col(PART) / TOGETHER).cast("int")).repartition(parts, PART)
        blocks = checkpoint(_pool_parts(blocks.sortWithinPartitions(PART, "low")))
    return blocks.drop(PART)


@dataclass(frozen=True)
class Isotonic:
    """Knots (prediction, rate): both ends of every block."""

    x: np.ndarray
    y: np.ndarray

    def apply(self, rows: DataFrame, p: str, out: str) -> DataFrame:
        """rows with `out`: the rate at p, on straight lines between knots, the ends' rates outside; null stays null, all is null without knots."""
        schema = rows.withColumn(out, F.lit(None).cast("double")).schema
        x, y = self.x, self.y

        def run(batches):
            for batch in batches:
                values = batch.column(p).to_numpy(zero_copy_only=False).astype(float)
                found = np.clip(np.interp(values, x, y), EDGE, 1 - EDGE) if len(x) else np.full(len(values), np.nan)
                yield batch.append_column(out, pa.array(found, pa.float64(), mask=~np.isfinite(found)))

        return rows.drop(out).mapInArrow(run, schema) if out in rows.columns else rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Temperature:
    """log odds / temperature + bias."""

    temperature: float
    bias: float
    log_loss: float

    def apply(self, rows: DataFrame, p: str, out: str) -> DataFrame:
        return rows.withColumn(out, scaled(logit(F.col(p)), self.temperature, self.bias))


def scaled(odds: Column, temperature: float, bias: float) -> Column:
    p = 1.0 / (1.0 + F.exp(-(odds / F.lit(temperature) + F.lit(bias))))
    return F.greatest(F.least(p, F.lit(1 - EDGE)), F.lit(EDGE))


def fit_isotonic(rows: DataFrame) -> Isotonic:
    blocks = sorted(tuple(r) for r in isotonic_blocks(rows).collect())  # at most some 3 n^(2/3)
    ends = {}
    for low, high, n, n1 in blocks:
        ends[low] = ends[high] = n1 / n
    return Isotonic(np.array(list(ends)), np.array(list(ends.values())))


def fit_temperature(rows: DataFrame) -> Temperature:
    """The grid's least log loss, the first by temperature and bias among equals; 1 and 0 without rows."""
    n_t, n_b = len(TEMPERATURES), len(BIASES)

    def losses(batch):
        p, n, n1 = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("p", "n", "n1"))
        q = np.clip(p, 1e-6, 1 - 1e-6)
        odds, total = np.log(q / (1 - q)), np.zeros((n_t, n_b))
        for i, t in enumerate(TEMPERATURES):
            for at in range(0, len(odds), 4096):
                part = slice(at, at + 4096)
                s = np.clip(1 / (1 + np.exp(-(odds[part, None] / t + BIASES))), EDGE, 1 - EDGE)
                total[i] -= n1[part] @ np.log(s) + (n[part] - n1[part]) @ np.log1p(-s)
        return np.append(total.ravel(), n.sum())

    found = summed(counted(rows), n_t * n_b + 1, losses)
    if not found[-1]:
        return Temperature(1.0, 0.0, float("nan"))
    mean = found[:-1] / found[-1]
    at = int(np.flatnonzero(mean <= mean.min() + 1e-12)[0])  # sums of tasks come in any order
    return Temperature(float(TEMPERATURES[at // n_b]), float(BIASES[at % n_b]), float(mean[at]))


def fit(rows: DataFrame, method: str = "auto") -> Isotonic | Temperature:
    """The calibrator of rows (p, y): isotonic with LEAST_ISOTONIC labels or more if `auto`, one temperature otherwise."""
    if method == "auto":
        enough = rows.where("p is not null and y is not null").limit(LEAST_ISOTONIC).count() >= LEAST_ISOTONIC
        method = "isotonic" if enough else "temperature"
    return {"isotonic": fit_isotonic, "temperature": fit_temperature}[method](rows)
