"""Counting pairs without forming them."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs_only_excluded_by(rows: DataFrame, rule: str, others: list[str]) -> DataFrame:
    """One row, `pairs`: ordered pairs of different rows that agree in `rule` and in none of `others` (O5.9).

    A null agrees with nothing. By inclusion and exclusion: of the pairs that agree in the rule
    those that agree in one other key are taken off, those in two are put back, and so on; each
    of these is a sum of n (n - 1) over groups. Rows are counted by all keys once, so a key that
    holds most rows is a few rows of the sums.
    """
    counts = rows.where(F.col(rule).isNotNull()).groupBy(rule, *others).agg(F.count("*").cast("decimal(38,0)").alias("n"))
    sums = []
    for size in range(len(others) + 1):
        for keys in combinations(others, size):
            known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys), F.lit(True))
            groups = counts.where(known).groupBy(rule, *keys).agg(F.sum("n").alias("n"))
            sums.append(groups.agg((F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0)) * (-1) ** size).alias("pairs")))
    return reduce(DataFrame.unionByName, sums).agg(F.sum("pairs").cast("long").alias("pairs"))


def shared_sites(rows: DataFrame, site: str, station: str) -> DataFrame:
    """One row: rows with a site, sites, sites of several stations, and the stations and rows at those (O5.9)."""
    per = rows.where(F.col(site).isNotNull()).groupBy(site, station).agg(F.count("*").alias("n"))
    sites = per.groupBy(site).agg(F.count(station).alias("stations"), F.sum("n").alias("n"))
    shared: Column = F.col("stations") > 1
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return sites.agg(
        total("n", "n_rows"), F.count("*").alias("n_sites"), F.count_if(shared).alias("n_shared"), total(F.when(shared, F.col("stations")), "stations_there"), total(F.when(shared, F.col("n")), "rows_there")
    )
