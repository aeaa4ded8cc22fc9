"""Precedent search: exact nearest neighbours under candidate rules, and what they agree on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlane.functions.ranking import PART, in_order


def nearest(pool: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine", cold: bool = False, block: int = 4096) -> DataFrame:
    """query_id, id, rank: the k nearest pool rows of each query, ties by id (O8.9).

    pool and queries have id, entity and vec (array of floats). The warm rule leaves out the
    query itself; the cold rule also rows of the query's entity, where a null entity is
    nobody's (O5.8). The stated queries are read in blocks of about `block` rows; each block is
    broadcast and the pool scanned against it, so no pool row is copied. A task keeps the k
    best of each query, and only these are exchanged. A vector without length has likeness 0
    to all.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    spark = pool.sparkSession
    asked = queries.select("id", "entity", "vec")
    blocks, found = max(1, -(-asked.count() // block)), None
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect()  # about `block` rows
        held = spark.sparkContext.broadcast([(r["id"], r["entity"], r["vec"]) for r in rows])
        one = pool.select("id", "entity", "vec").mapInArrow(_best_of(held, k, metric, cold), "query_id long, id long, near double")
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "rank")


def _likeness(q: np.ndarray, p: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """Likeness of all pairs by matrix products, and how far it may be from the exact one."""
    dot = q @ p.T
    if metric == "cosine":
        scale = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(p, axis=1)[None, :]
        return np.where(scale > 0, dot / np.where(scale > 0, scale, 1), 0.0), 0.0
    squares = (q * q).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * dot
    return -np.sqrt(np.maximum(squares, 0.0)), 1e-6 * (1.0 + float(np.sqrt(squares.max(initial=0.0))))


def _best_of(held, k: int, metric: str, cold: bool):
    """A task's k best pool rows of each query of the block."""

    def run(batches):
        asked = held.value
        if not asked:
            return
        q = np.array([x[2] for x in asked], dtype=np.float64)
        names = np.array([x[0] for x in asked])
        entities = np.array([x[1] for x in asked], dtype=object)
        known = np.array([x is not None for x in entities])
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query, id, likeness
        worst = np.full(len(asked), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                p = np.array(part.column("vec").to_pylist(), dtype=np.float64)
                ids = part.column("id").to_numpy()
                near, off = _likeness(q, p, metric)
                bad = names[:, None] == ids[None, :]
                if cold:
                    bad |= known[:, None] & (entities[:, None] == np.array(part.column("entity").to_pylist(), dtype=object)[None, :])
                near = np.where(bad, -np.inf, near)
                bar = np.maximum(np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else worst, worst)
                row, column = np.nonzero((near >= bar[:, None] - 2 * off) & (near > -np.inf))
                exact = near[row, column] if metric == "cosine" else -np.sqrt(((q[row] - p[column]) ** 2).sum(axis=1))
                merged = [np.concatenate(x) for x in zip(best, (row, ids[column], exact))]
                order = np.lexsort((merged[1], -merged[2], merged[0]))
                merged = [x[order] for x in merged]
                first = np.searchsorted(merged[0], merged[0])
                place = np.arange(len(first)) - first
                best = tuple(x[place < k] for x in merged)
                last = merged[0][place == k - 1]
                worst[last] = merged[2][place == k - 1]
        yield pa.RecordBatch.from_arrays([pa.array(names[best[0]].astype(np.int64)), pa.array(best[1]), pa.array(best[2])], ["query_id", "id", "near"])

    return run


def agreement(found: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, agreement: the share of a query's neighbours with its label (O6.16)."""
    own = labels.select(F.col("id").alias("query_id"), F.col("label").alias("_own"))
    joined = found.join(labels.select("id", "label"), "id").join(own, "query_id")
    same = F.when(F.col("label") == F.col("_own"), 1.0).otherwise(0.0)
    return joined.groupBy("query_id").agg(F.round(F.avg(same), 9).alias("agreement"))


def chance_level(labels: DataFrame) -> DataFrame:
    """One row: the sum of squared label shares (O6.15)."""
    counts = labels.groupBy("label").agg(F.count("*").alias("k"))
    return counts.agg(F.round(F.sum(F.col("k") * F.col("k")) / (F.sum("k") * F.sum("k")), 9).alias("chance"))


def same_station(rows: DataFrame, k: int = 5) -> DataFrame:
    """query_id, id, rank: the k rows of the same station before the query, latest first (O8.10).

    rows: obs_id, station, start. Rows are dealt in the order of station and time into even
    partitions, so a long history is cut; the last k rows of each partition are also lent to
    the partitions behind it in which their station goes on.
    """
    order = ["station", "start", "obs_id"]
    dealt = in_order(rows.where("station is not null").select(*order), order)
    last = Window.partitionBy(PART).orderBy(*(F.desc(c) for c in order))
    tails = dealt.withColumn("from the end", F.row_number().over(last)).where(F.col("from the end") <= k).drop("from the end")
    firsts = dealt.groupBy(PART).agg(F.min("station").alias("station"))  # one row for each partition
    behind = F.broadcast(firsts.withColumnRenamed(PART, "to"))
    lent = tails.join(behind, "station").where(F.col("to") > F.col(PART))
    near = Window.partitionBy("to").orderBy(F.desc("start"), F.desc("obs_id"))
    guests = lent.withColumn("from the end", F.row_number().over(near)).where(F.col("from the end") <= k)  # k rows for each partition
    both = dealt.withColumn("guest", F.lit(False)).unionByName(guests.select(*order, F.col("to").alias(PART), F.lit(True).alias("guest")))
    before = Window.partitionBy(PART, "station").orderBy("start", "obs_id").rowsBetween(-k, -1)
    ids = F.reverse(F.collect_list("obs_id").over(before))
    listed = both.select(F.col("obs_id").alias("query_id"), ids.alias("ids"), "guest").where("not guest")
    return listed.select("query_id", F.posexplode("ids").alias("at", "id")).select("query_id", "id", (F.col("at") + 1).alias("rank"))
