"""Ranks, positions and percentiles over whole tables without a window over all rows.

Rows are dealt into partitions that follow one another in the order asked for, and written
down so. What a partition starts from comes from one row for each partition. Values are
counted first, with map-side combination, so a value that a third of all rows hold is one
row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlane.functions.materialize import attach, checkpoint

PART, START, PLACE = "part of the order", "start of the part", "place in the order"
MOST_FIRST = 100_000  # rows that a task may keep of an order


def in_order(df: DataFrame, order: list[str], written: bool = False) -> DataFrame:
    """df with PART: numbers of partitions that follow one another in the order of the columns.

    written: df is materialised already. Spark reads it twice, once for the partitions' bounds.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (df if written else checkpoint(df)).repartitionByRange(parts, *order)
    return checkpoint(dealt.withColumn(PART, F.spark_partition_id()))


def _starts(dealt: DataFrame, total: Column) -> DataFrame:
    """PART and START: the total of all partitions before; one row for each partition."""
    sums = dealt.groupBy(PART).agg(total.alias("sum"))
    return F.broadcast(sums.select(PART, (F.sum("sum").over(Window.orderBy(PART)) - F.col("sum")).alias(START)))


def running_total(counts: DataFrame, by: list[str], order: list[str], n: str, out: str) -> DataFrame:
    """counts with `out`: the sum of n over the rows of the same `by` that come before by `order` (unique in `by`)."""
    dealt = in_order(counts, [*by, *order])
    within = Window.partitionBy(PART).orderBy(*by, *order)
    before = F.col(START) + F.sum(n).over(within) - F.col(n)
    placed = dealt.join(_starts(dealt, F.sum(n)), PART).withColumn(out, before).drop(PART, START)
    if not by:
        return placed
    placed = checkpoint(placed)
    first = placed.groupBy(*by).agg(F.min(out).alias(START))
    return attach(placed, first, by).withColumn(out, F.col(out) - F.col(START)).drop(START)


def average_rank(df: DataFrame, value: str, out: str, by: list[str] = ()) -> DataFrame:
    """df with `out`: the rank of value in its group from 1, ties averaged (O7.1); value is not null."""
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n of value"))
    placed = running_total(counts, by, [value], "n of value", out)
    ranks = placed.select(*by, value, (F.col(out) + (F.col("n of value") + 1) / 2.0).alias(out))
    return attach(df, ranks, [*by, value])


def positions(df: DataFrame, value: str, key: str, out: str) -> DataFrame:
    """df with `out`: the row's place from 0 by (value, key) ascending; key is unique (O8.1). The result is written down."""
    dealt = in_order(df, [value, key])
    local = F.row_number().over(Window.partitionBy(PART).orderBy(value, key)) - 1
    placed = dealt.join(_starts(dealt, F.count("*")), PART).withColumn(out, (F.col(START) + local).cast("long"))
    return checkpoint(placed.drop(PART, START))


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows by one or two columns ascending; the last is unique.

    Each task keeps n of its rows and one task n of those, so nothing is dealt or written down.
    More than MOST_FIRST rows are found by their positions.
    """
    if n <= MOST_FIRST:
        return df.orderBy(*order).limit(n)
    return positions(df, order[0], order[-1], PLACE).where(F.col(PLACE) < n).drop(PLACE)


def running_max(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """df with `out`: the largest value up to the row in the order of a unique column."""
    dealt = in_order(df, [order])
    most = dealt.groupBy(PART).agg(F.max(value).alias("most"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    carried = F.broadcast(most.select(PART, F.max("most").over(before).alias(START)))
    here = F.max(value).over(Window.partitionBy(PART).orderBy(order))
    return dealt.join(carried, PART).withColumn(out, F.greatest(here, START)).drop(PART, START)


def percentiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    """by and, for each name, the interpolated percentile of value in the group (O6.24); nulls are left out.

    Values are counted and their counts summed up in order, so no group's values are held together.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n of value"))
    placed = checkpoint(running_total(counts, by, [value], "n of value", "before"))
    sized = attach(placed, placed.groupBy(*by).agg(F.sum("n of value").alias("n of group")), by)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n of value")), F.col(value)))

    def percentile(share: float) -> Column:
        place = (F.col("n of group") - 1) * F.lit(share)
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place - F.floor(place))
        return low + (high - low) * part

    return sized.groupBy(*by).agg(*(percentile(q).alias(name) for name, q in shares.items()))
