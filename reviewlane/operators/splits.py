"""Leakage-safe splits, their audits and the rules for duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlane.functions.materialize import attach, checkpoint
from reviewlane.functions.ranking import positions, running_max
from reviewlane.functions.records import seconds

PARTITIONS = ["train", "calibration", "test"]


def named(order: Column) -> Column:
    return F.when(order == 0, "train").when(order == 1, "calibration").otherwise("test")


def chronological(rows: DataFrame, train: float = 0.70, calibration: float = 0.15) -> DataFrame:
    """rows (obs_id, start, episode) with partition: cut by time, then each episode takes its earliest part (O7.3)."""
    placed = positions(rows.withColumn("time of row", seconds(F.col("start"))), "time of row", "obs_id", "place of row")
    n = placed.count()
    first, second = int(n * train), int(n * train) + int(n * calibration)
    place = F.col("place of row")
    cut = placed.withColumn("part of row", F.when(place < first, 0).when(place < second, 1).otherwise(2))
    least = cut.groupBy("episode").agg(F.min("part of row").alias("least part"))
    return cut.join(least, "episode").withColumn("partition", named(F.col("least part"))).drop("time of row", "place of row", "part of row", "least part")


def islands(ids: DataFrame, column: str, gap: int = 5) -> DataFrame:
    """column, rep: distinct catalogue numbers and the least of their cluster; a gap over `gap` parts clusters (O7.7).

    A number starts a cluster if none of the `gap` before it exists; this needs no order.
    """
    distinct = ids.select(F.col(column).cast("long").alias(column)).where(F.col(column).isNotNull()).distinct()
    followed = distinct.select(F.explode(F.sequence(F.col(column) + 1, F.col(column) + gap)).alias(column)).distinct()
    starts = distinct.join(followed, column, "left_anti").withColumn("start of cluster", F.col(column))
    marked = distinct.join(starts, column, "left")
    return running_max(marked, column, "start of cluster", "rep").select(column, "rep")


def cold_entity(rows: DataFrame, entity: str, test: float = 0.15, calibration: float = 0.15, seed: str = "0") -> DataFrame:
    """rows with partition by entity: entities in the order of a hash; at least one goes to test and to calibration (O12.2)."""
    reps = checkpoint(rows.select(entity).where(F.col(entity).isNotNull()).distinct())
    n = reps.count()
    n_test, n_cal = max(1, int(n * test)), max(1, int(n * calibration))
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(entity).cast("string"))), 1, 12), 16, 10).cast("long")
    placed = positions(reps.withColumn("hash of entity", hashed), "hash of entity", entity, "place")
    order = F.when(F.col("place") < n_test, 2).when(F.col("place") < n_test + n_cal, 1).otherwise(0)
    parts = placed.select(entity, named(order).alias("partition"))
    return attach(rows, parts, [entity], "left").withColumn("partition", F.coalesce("partition", F.lit("excluded")))


def combined(a: Column, b: Column) -> Column:
    """The part that both splits agree on, or `excluded` (O9.4)."""
    return F.when(a == b, a).otherwise("excluded")


def first_partition_wins(rows: DataFrame, digest: str, key: str) -> DataFrame:
    """Rows of one digest move to the part of the least id; null digests stay (O7.5). No group is collected."""
    first = rows.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min_by("partition", key).alias("first part"), F.count("*").alias("n of digest"))
    shared = first.where(F.col("n of digest") > 1).drop("n of digest")  # a digest on one row moves nothing
    return attach(rows, shared, [digest], "left").withColumn("partition", F.coalesce("first part", "partition")).drop("first part")


def exclude_duplicates(rows: DataFrame, digest: str, key: str) -> DataFrame:
    """Later rows of one digest become `excluded`, counted among rows that are not (O7.6)."""
    first = rows.where((F.col("partition") != "excluded") & F.col(digest).isNotNull()).groupBy(digest).agg(F.min(key).alias("first row"), F.max(key).alias("last row"))
    shared = first.where(F.col("last row") > F.col("first row")).drop("last row")
    later = F.col(key) > F.col("first row")
    return attach(rows, shared, [digest], "left").withColumn("partition", F.when(later, "excluded").otherwise(F.col("partition"))).drop("first row")


def composition(rows: DataFrame) -> DataFrame:
    """Counts by part: rows, labels, distinct stations, transmitters and days (O6.2)."""
    return rows.groupBy("partition").agg(
        F.count("*").alias("n"),
        *(F.count_if(F.col("label") == x).alias(x.replace("-", "_")) for x in ("with-signal", "without-signal", "unknown")),
        F.count_distinct("station").alias("stations"),
        F.count_distinct("transmitter").alias("transmitters"),
        F.count_distinct(F.to_date("start")).alias("days"),
    )


def entity_spread(rows: DataFrame, entities: list[str]) -> DataFrame:
    """entity, spread, examined, no_key, excluded: for each entity column how many of its values lie in more than one part (O6.3).

    One pass for all entities: each row counts once for each, and distinct (entity, value, part)
    combine early, so a frequent value is a few rows.
    """
    stacked = F.explode(F.array(*(F.struct(F.lit(e).alias("entity"), F.col(e).cast("string").alias("value")) for e in entities))).alias("e")
    cells = checkpoint(rows.select(stacked, "partition").groupBy("e.entity", "e.value", "partition").agg(F.count("*").alias("n")))
    used = (F.col("partition") != "excluded") & F.col("value").isNotNull()
    parts = cells.where(used).groupBy("entity", "value").agg(F.count("*").alias("k"))
    counts = parts.groupBy("entity").agg(F.count_if(F.col("k") > 1).alias("spread"), F.count("*").alias("examined"))
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0).cast("long"))
    skipped = cells.groupBy("entity").agg(
        of((F.col("partition") != "excluded") & F.col("value").isNull()).alias("no_key"), of(F.col("partition") == "excluded").alias("excluded")
    )
    named_ = rows.sparkSession.createDataFrame([(e,) for e in entities], "entity string")
    both = named_.join(counts, "entity", "left").join(skipped, "entity", "left")  # one row an entity
    return both.select("entity", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("spread", "examined", "no_key", "excluded")))


def leakage_audit(splits: dict[str, DataFrame], entities: list[str], by_design: set[tuple[str, str]]) -> DataFrame:
    """A row for each split and entity with PASS, FAIL or BY_DESIGN; a check over nothing fails (O6.4)."""
    out = None
    for split, rows in splits.items():
        one = entity_spread(rows, entities).withColumn("split", F.lit(split))
        meant = [e for s, e in sorted(by_design) if s == split]
        bad = F.when(F.col("entity").isin(meant), "BY_DESIGN").otherwise("FAIL") if meant else F.lit("FAIL")
        one = one.withColumn("result", F.when(F.col("examined") == 0, "FAIL").when(F.col("spread") == 0, "PASS").otherwise(bad))
        out = one if out is None else out.unionByName(one)
    return out
