"""Uniform sharding with exact sizes by a hypergeometric communication matrix.

Rows lie in P virtual partitions (a hash of the row). The driver knows only how many rows
each has. Shard capacities differ by at most one. For a uniformly random arrangement of
all rows, the counts that one partition sends to each shard follow a multivariate
hypergeometric law, so the P x S matrix is drawn row by row against what is left of the
capacities. Then rows are permuted inside their partition by a seeded hash, the first
matrix[p][0] go to shard 0 and so on; after the exchange they are permuted again inside
the shard. No step needs all rows in one task: a shard is cut by the second hash into
sub-buckets whose counts give each its first slot.

Defined results: law `rows`; the same rows, seed and partition count give the same shards
whatever the input's layout; rows of equal content are interchangeable (ties between them
are cut arbitrarily and give the same set of rows); null ids and texts are hashed as they
are; a very long text is one row like any; an empty table gives no rows; fewer rows than
shards leaves some shards empty; other columns pass, whatever their names (`shard` and
`slot` are replaced). Counts have no bound.

Limit: rows that are equal in all of `key` lie in one partition and one sub-bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlane.llm.common import aside, restored


_NUMPY_BOUND = 10**9  # numpy draws hypergeometric numbers from smaller totals only


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of n rows, drawn from good + bad, are good.

    Beyond numpy's bound by inversion: the ratios of neighbouring probabilities are multiplied
    outwards from the mode over 40 standard deviations, past which less than 1e-300 is left.
    """
    total = good + bad
    if total < _NUMPY_BOUND or not (good and bad and n) or n == total:
        return int(rng.hypergeometric(good, bad, n)) if total < _NUMPY_BOUND else n if not bad else 0 if not (good and n) else good
    share = good / total
    spread = (n * share * (1 - share) * (total - n) / max(1, total - 1)) ** 0.5
    mode = (n + 1) * (good + 1) // (total + 2)
    low = max(0, n - bad, int(mode - 40 * spread) - 40)
    high = min(good, n, int(mode + 40 * spread) + 40)
    k = np.arange(low, high, dtype=np.float64)
    ratio = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    height = np.concatenate(([0.0], np.cumsum(ratio)))
    weight = np.cumsum(np.exp(height - height.max()))
    return low + int(np.searchsorted(weight, rng.random() * weight[-1], side="right"))


def communication_matrix(counts: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """matrix[p][s]: rows that partition p sends to shard s; exact row and column sums.

    A multivariate hypergeometric row is drawn as one number after another, each from what is left.
    """
    total = int(counts.sum())
    left = np.full(n_shards, total // n_shards, dtype=np.int64)
    rng = np.random.default_rng(seed)
    left[rng.permutation(n_shards)[: total % n_shards]] += 1
    matrix = np.zeros((len(counts), n_shards), dtype=np.int64)
    for p, count in enumerate(counts):
        n, rest = int(count), int(left.sum())
        for s in range(n_shards):
            rest -= int(left[s])
            matrix[p, s] = hypergeometric(int(left[s]), rest, n, rng) if rest else n
            n -= int(matrix[p, s])
        left -= matrix[p]
    return matrix


def shard_rows(
    rows: DataFrame, key: list[Column], n_shards: int = 40, seed: int = 0, partitions: int | None = None
) -> DataFrame:
    """rows with `shard` (int) and `slot` (long, gapless from 0 in each shard).

    key: columns that tell rows apart. partitions: P; by default four times the session's
    shuffle partitions, so the driver's matrix grows with the cluster and not with the rows.
    """
    spark = rows.sparkSession
    parts = partitions or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashes = [F.xxhash64(F.lit(seed + i), *key) for i in range(3)]
    held = aside(rows.select("*", F.struct(*(k.alias(f"k{i}") for i, k in enumerate(key))), *hashes))
    n = len(rows.columns)
    ties, whole, first, second = (f"_own{n + i}" for i in range(4))
    sub = F.pmod(F.shiftright(second, 8), F.lit(max(1, parts // n_shards))).cast("int")
    dealt = held.withColumns({"part": F.pmod(F.col(whole), F.lit(parts)).cast("int"), "sub": sub})
    counts = np.zeros(parts, dtype=np.int64)
    for r in dealt.groupBy("part").count().collect():  # at most P rows
        counts[r["part"]] = r["count"]
    matrix = communication_matrix(counts, n_shards, seed)
    ends = spark.createDataFrame([(p, row.tolist()) for p, row in enumerate(matrix.cumsum(axis=1))], "part int, ends array<long>")
    within = Window.partitionBy("part").orderBy(first, ties)
    sent = (
        dealt.withColumn("rank", F.row_number().over(within).cast("long"))
        .join(F.broadcast(ends), "part")  # P rows
        .withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))))
    )
    buckets = sent.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    starts = buckets.select("shard", "sub", (F.sum("n").over(Window.partitionBy("shard").orderBy("sub")) - F.col("n")).alias("start"))
    local = Window.partitionBy("shard", "sub").orderBy(second, ties)
    slotted = (
        sent.withColumn("at", F.row_number().over(local) - 1)
        .join(F.broadcast(starts), ["shard", "sub"])  # at most P rows
        .withColumn("slot", (F.col("start") + F.col("at")).cast("long"))
    )
    return slotted.select(*restored(slotted, rows, ("shard", "slot")), "shard", "slot")
