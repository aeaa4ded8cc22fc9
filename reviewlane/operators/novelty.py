"""What a model has not seen: entities that no training row has, and vectors far from all of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlane.functions.materialize import attach, checkpoint
from reviewlane.functions.ranking import percentiles


def unseen(rows: DataFrame, train: DataFrame, entities: list[str]) -> DataFrame:
    """rows with unseen_<entity>: whether no training row has the row's value; an unknown value counts as one value (O5.4, O5.5)."""
    for e in entities:
        key = F.coalesce(F.col(e).cast("string"), F.lit("unknown"))
        seen = train.select(key.alias("value seen")).distinct().withColumn("is seen", F.lit(True))
        marked = attach(rows.withColumn("value seen", key), seen, ["value seen"], "left")
        rows = marked.withColumn(f"unseen_{e}", F.col("is seen").isNull()).drop("value seen", "is seen")
    return rows


class Distances:
    """Mahalanobis distances from training rows; nulls and NaN take the training median (O12.14)."""

    def __init__(self, train: DataFrame, features: list[str], quantile: float = 0.99):
        self.features = features
        cells = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), _finite(f).alias("value")) for f in features))).alias("c")
        stacked = train.select(cells).select("c.feature", "c.value")
        found = {r["feature"]: r["m"] for r in percentiles(stacked, "value", {"m": 0.5}, ["feature"]).collect()}  # one row a feature
        self.medians = {f: found.get(f, 0.0) for f in features}
        filled = checkpoint(train.select(*(self._filled(f).alias(f) for f in features)))
        d = len(features)
        self.n = filled.count()
        self.limit, self.mean, self.inverse = float("inf"), [0.0] * d, None
        if self.n < 3 * d:
            return  # too few rows for a covariance
        self.mean = list(filled.agg(*(F.avg(f) for f in features)).first())
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        centred = [F.col(f) - m for f, m in zip(features, self.mean)]
        sums = filled.agg(*(F.sum(centred[i] * centred[j]) for i, j in pairs)).first()
        cov = np.zeros((d, d))
        for (i, j), s in zip(pairs, sums):
            cov[i, j] = cov[j, i] = s / (self.n - 1)
        # A nearly constant feature would else make every row an outlier.
        self.inverse = np.linalg.pinv(cov + 1e-6 * np.trace(cov) / d * np.eye(d))
        far = percentiles(filled.select(F.lit(0).alias("all"), self._distance().alias("distance")), "distance", {"q": quantile}, ["all"])
        self.limit = far.first()["q"]

    def _filled(self, f: str) -> Column:
        return F.coalesce(_finite(f), F.lit(float(self.medians[f])))

    def _distance(self) -> Column:
        if self.inverse is None:
            return F.lit(0.0)
        d = [F.col(f) - m for f, m in zip(self.features, self.mean)]
        total = F.lit(0.0)
        for i in range(len(d)):
            for j in range(len(d)):
                total = total + d[i] * d[j] * float(self.inverse[i, j])
        return F.sqrt(F.greatest(total, F.lit(0.0)))

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with feature_distance and feature_novelty."""
        own = {f: F.col(f) for f in self.features}
        kept = F.struct(*own.values())
        filled = rows.withColumn("features as read", kept).withColumns({f: self._filled(f) for f in self.features}).withColumn("feature_distance", self._distance())
        back = {f: F.col("features as read").getField(f) for f in self.features}
        return filled.withColumns(back).withColumn("feature_novelty", F.col("feature_distance") > self.limit).drop("features as read")


def _finite(f: str) -> Column:
    x = F.col(f).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def risk_by_novelty(rows: DataFrame, flags: list[str]) -> DataFrame:
    """axis, flagged, unflagged and their error shares; informative with ten flagged rows that err more (O6.14)."""
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("axis"), F.col(f).alias("flag")) for f in flags))).alias("c")
    wrong = ((F.col("p") >= 0.5).cast("int") != F.col("y")).cast("long")
    each = rows.select(cells, wrong.alias("wrong")).groupBy("c.axis").agg(
        F.count_if("c.flag").alias("flagged"), F.count_if(~F.col("c.flag")).alias("unflagged"),
        F.sum(F.when(F.col("c.flag"), F.col("wrong"))).alias("f"), F.sum(F.when(~F.col("c.flag"), F.col("wrong"))).alias("u"),
    )
    share = lambda e, n: F.round(F.col(e) / F.when(F.col(n) > 0, F.col(n)), 9)
    out = each.select("axis", "flagged", "unflagged", share("f", "flagged").alias("flagged_risk"), share("u", "unflagged").alias("unflagged_risk"))
    return out.withColumn("informative", F.coalesce((F.col("flagged") >= 10) & (F.col("flagged_risk") > F.col("unflagged_risk")), F.lit(False)))


def interpolated(samples: DataFrame, series: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """samples with `value`: the series of the same `by` read at the sample's place, linear between points, its end values outside (O5.12).

    One sort for both: each sample takes the last point at or before it and the first after it.
    Points of one place count as their least value.
    """
    points = series.where(F.col(value).isNotNull()).groupBy(by, at).agg(F.min(value).alias(value))
    marked = samples.select("*", F.lit(None).cast("double").alias(value), F.lit(1).alias("asked")).unionByName(
        points.select(by, at, F.col(value).cast("double").alias(value), F.lit(0).alias("asked")), allowMissingColumns=True
    )
    point = F.when(F.col("asked") == 0, F.struct(F.col(at).alias("x"), F.col(value).alias("y")))
    back = Window.partitionBy(by).orderBy(at, "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(by).orderBy(F.desc(at), "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = marked.withColumn("a", F.last(point, ignorenulls=True).over(back)).withColumn("b", F.last(point, ignorenulls=True).over(ahead))
    span = F.col("b.x") - F.col("a.x")
    line = F.col("a.y") + (F.col("b.y") - F.col("a.y")) * (F.col(at) - F.col("a.x")) / F.when(span != 0, span)
    return near.where("asked = 1").withColumn(value, F.coalesce(line, "a.y", "b.y")).drop("asked", "a", "b")
