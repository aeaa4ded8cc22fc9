"""Frames that the queries read: the driver's tables in the roles of observation records.

Only the named columns are read, so that scans are pruned to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs_id, station, transmitter, start, label, episode: orders as observations (O5.1, O5.2).

    An order whose customer is missing keeps its row with a null transmitter.
    """
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("obs_id"), F.col("o_custkey").alias("station"), F.col("o_orderdate").alias("start"), "o_orderstatus"
    )
    stations = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("station"), F.col("c_nationkey").alias("transmitter"))
    label = F.when(F.col("o_orderstatus") == "F", "with-signal").when(F.col("o_orderstatus") == "O", "without-signal").otherwise("unknown")
    return orders.join(stations, "station", "left").select(
        "obs_id",
        "station",
        "transmitter",
        "start",
        label.alias("label"),
        F.concat_ws(":", "station", "transmitter", F.year("start")).alias("episode"),
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs_id with prob, offset_ppm, at_bound, flat, spread: line items as measurements.

    Sums are taken over whole numbers, so results do not depend on the order of rows.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    discount, tax, quantity = (F.round(F.col(c) * k).cast("long") for c, k in (("l_discount", 100), ("l_tax", 100), ("l_quantity", 1)))
    per = lines.groupBy(F.col("l_orderkey").alias("obs_id")).agg(
        F.count("*").alias("n"),
        F.sum(discount).alias("d"),
        F.sum(quantity).alias("q"),
        F.max(quantity).alias("q_max"),
        F.max(tax).alias("t"),
        (F.max(discount) - F.min(discount)).alias("s"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("r"),
    )
    return per.select(
        "obs_id",
        F.when(F.col("r") > 0, F.col("d") / (F.col("n") * 10.0)).alias("prob"),
        ((F.col("q") / F.col("n") - 25.0) * 2.0).alias("offset_ppm"),
        (F.col("q_max") >= 50).alias("at_bound"),
        (F.col("t") / 40.0).alias("flat"),
        (F.col("s") / 10.0).alias("spread"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with their measurements; unmeasured ones keep null measurements."""
    return observations(spark, sf_dir).join(measurements(spark, sf_dir), "obs_id", "left")
