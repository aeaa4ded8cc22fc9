"""Samples whose rows are settled by a digest of seed and id, so that any run draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlane.functions.ranking import running_total


def lot(key: Column, seed: int) -> Column:
    """A row's lot: 48 bits of a digest, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 12), 16, 10).cast("long")


def random_rows(rows: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows without replacement (O8.11); no total sort is needed."""
    return rows.orderBy(lot(F.col(key), seed), key).limit(k)


def balanced(rows: DataFrame, label: str, key: str, per_class: int, seed: int = 0) -> DataFrame:
    """per_class rows of each label, all of a smaller one (O8.15). Each task keeps as many of a label before the exchange."""
    order = Window.partitionBy(label).orderBy(lot(F.col(key), seed), key)
    return rows.withColumn("place of row", F.row_number().over(order)).where(F.col("place of row") <= per_class).drop("place of row")


def whole_groups(rows: DataFrame, group: str, least: int, seed: int = 0) -> DataFrame:
    """Whole groups in the order of their lots until `least` rows are reached (O8.18)."""
    sizes = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("rows of group"))
    placed = running_total(sizes.withColumn("lot of group", lot(F.col(group), seed)), [], ["lot of group", group], "rows of group", "rows before")
    return rows.join(placed.where(F.col("rows before") < least).select(group), group, "left_semi")


def diverse(rows: DataFrame, family: str, key: str, by: str, target: int) -> DataFrame:
    """`target` rows by turns: the best of each family, largest family first, then the second best, and so on (O8.14).

    No family gives more than `target` rows, and each task keeps as many of it before the exchange.
    """
    order = Window.partitionBy(family).orderBy(F.desc(F.coalesce(F.col(by), F.lit(0))), key)
    best = rows.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= target)
    sizes = rows.groupBy(family).agg(F.count("*").alias("rows of family"))
    joined = best.join(sizes, best[family].eqNullSafe(sizes[family])).drop(sizes[family])
    first = joined.orderBy("turn", F.desc("rows of family"), family).limit(target)
    return first.drop("rows of family")
