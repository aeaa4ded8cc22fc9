"""Hard-negative mining: for each anchor's nearest rows of its label the hardest rows of other labels below them.

Vectors become whole numbers, floor(scale x), so scores (inner products) are exact. Anchors and
rows meet in cells: anchors are dealt into teams whose vectors fit TEAM_BYTES, rows into chunks,
and a cell is a team and a chunk. The exchange brings each row to one cell of every team and each
anchor to one cell of every chunk; a cell holds its anchors and reads its rows batch by batch, so
memory is bounded whatever share of rows a label or an id has. For each anchor all scores of a
batch are sorted by score and id. A first meeting keeps the best rows of the anchor's label (its
positives). In a second one the rows of other labels are read from the sorted scores: a binary
search finds each positive's upper limit, and the next k rows down to its lower limit are kept.
What cells keep is ranked once more for each anchor.

Defined results: rows with a null label, a null vector or a component that is null or not finite
take no part; vectors of different lengths are filled up with zeros; null ids ask for nothing
and rank last among equal scores; of rows with one id each asks and ranks on its own, and only
the row itself is left out of its positives; a row without another row of its label gives
nothing; an empty table gives no rows; other columns are not read, whatever their names. A score
that no 64-bit integer holds is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlane.functions.materialize import written

TEAM_BYTES = 32 * 2**20  # of anchors' vectors that a cell holds
CHUNK_ROWS = 2**18  # rows of a cell
POOL = 2**20  # rows that a cell has found before it keeps only the best


def usable(rows: DataFrame, label: str = "label", vector: str = "embedding") -> Column:
    """Whether a row takes part."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.col(label).isNotNull() & F.coalesce(finite, F.lit(False))


def _vectors(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Rows of floor(scale x) as doubles, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return out


def scores(block: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers."""
    bound = np.abs(block).max(initial=0.0) * np.abs(anchor).max(initial=0.0) * len(anchor)
    if bound < 2**53:  # every partial sum is a whole number that a double holds
        return (block @ anchor).astype(np.int64)
    whole = [int(x) for x in anchor]
    return np.array([sum(int(x) * y for x, y in zip(row, whole)) for row in block.tolist()], dtype=np.int64)


def sorted_by_score(found: np.ndarray, ids: np.ndarray, none: np.ndarray) -> np.ndarray:
    """Places of all scores, high ones first, ties by id, null ids last."""
    return np.lexsort((ids, none, ~found))


class _Best:
    """The k best (owner, place) rows found so far; columns are arrays."""

    def __init__(self, k: int):
        self.k, self.size, self.parts = k, 0, []

    def add(self, owner: int, place: int, found: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        if len(found):
            self.parts.append((np.full(len(found), owner), np.full(len(found), place), found, ids, none))
            self.size += len(found)
            if self.size > POOL:
                self.parts = [self.columns()]
                self.size = len(self.parts[0][0])

    def columns(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, bool))
        owner, place, found, ids, none = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, none, ~found, place, owner))
        owner, place = owner[order], place[order]
        fresh = np.concatenate(([True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])))
        rank = np.arange(len(owner)) - np.maximum.accumulate(np.where(fresh, np.arange(len(owner)), 0))
        kept = order[rank < self.k]
        return owner[rank < self.k], place[rank < self.k], found[kept], ids[kept], none[kept]


def _runs(batches):
    """(cell, asks, rows): parts of batches within one cell, its anchors before its rows."""
    for batch in batches:
        cell, asks = batch.column("cell").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (asks[1:] != asks[:-1])) + 1
        for start, end in zip([0, *cuts], [*cuts, len(cell)]):
            if end > start:
                yield int(cell[start]), bool(asks[start]), batch.slice(start, end - start)


def _ids(rows) -> tuple[np.ndarray, np.ndarray]:
    none = rows.column("id").is_null().to_numpy(zero_copy_only=False)
    return rows.column("id").fill_null(0).to_numpy(), none


def _cells(rows: DataFrame, anchors: DataFrame, carried: Column, teams: int, chunks: int) -> DataFrame:
    """Both sides dealt into cells, anchors (with `carried`) first in each."""
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    fields = ["uid", "id", "label", "vector"]
    asking = anchors.select(*fields, carried.alias("carried"), of(teams).alias("team"), number(chunks).alias("chunk"), F.lit(True).alias("asks"))
    nothing = F.lit(None).cast(asking.schema["carried"].dataType)
    asked = rows.select(*fields, nothing.alias("carried"), number(teams).alias("team"), of(chunks).alias("chunk"), F.lit(False).alias("asks"))
    both = asking.unionByName(asked).select(*fields, "carried", "asks", (F.col("team") * chunks + F.col("chunk")).alias("cell"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartitionById(min(teams * chunks, max(parts, 10_000)), F.col("cell")).sortWithinPartitions("cell", F.desc("asks"))


def positives(cells: DataFrame, dims: int, k: int, scale: int) -> DataFrame:
    """uid of the anchor, score, id: the k best rows of the anchor's label in each cell, without itself."""

    def result(best, uids):
        owner, _, found, ids, none = best.columns()
        return pa.RecordBatch.from_arrays([pa.array(uids[owner]), pa.array(found), pa.array(ids, mask=none)], ["uid", "score", "id"])

    def run(batches):
        at, held, best = None, [], None
        for cell, asks, rows in _runs(batches):
            if cell != at:
                if best:
                    yield result(best, uids)
                at, held, best = cell, [], None
            if asks:
                held.append(rows)
                continue
            if best is None:
                best, uids = _Best(k), np.concatenate([r.column("uid").to_numpy() for r in held] or [np.zeros(0, np.int64)])
                labels = np.concatenate([r.column("label").to_numpy() for r in held] or [np.zeros(0, np.int64)])
                vectors = np.concatenate([_vectors(r.column("vector"), dims, scale) for r in held] or [np.zeros((0, dims))])
            (ids, none), own, label = _ids(rows), rows.column("uid").to_numpy(), rows.column("label").to_numpy()
            block = _vectors(rows.column("vector"), dims, scale)
            for i in range(len(uids)):
                found = scores(block, vectors[i])
                order = sorted_by_score(found, ids, none)
                order = order[(label[order] == labels[i]) & (own[order] != uids[i])][:k]
                best.add(i, 0, found[order], ids[order], none[order])
        if best:
            yield result(best, uids)

    return cells.mapInArrow(run, "uid long, score long, id long")


def negatives(cells: DataFrame, dims: int, k: int, scale: int, low: int, high: int) -> DataFrame:
    """uid, anchor_id, place, positive_id, positive_score, negative_id, negative_score: for each positive the k best rows of other labels within its limits, in each cell."""
    names = ["uid", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]

    def result(best, uids, anchor_ids, carried):
        owner, place, found, ids, none = best.columns()
        positive = [carried[o][p] for o, p in zip(owner.tolist(), place.tolist())]
        columns = [uids[owner], anchor_ids[owner], place, [p["id"] for p in positive], [p["score"] for p in positive]]
        arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.array(ids, mask=none), pa.array(found)]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches):
        at, held, best = None, [], None
        for cell, asks, rows in _runs(batches):
            if cell != at:
                if best:
                    yield result(best, uids, anchor_ids, carried)
                at, held, best = cell, [], None
            if asks:
                held.append(rows)
                continue
            if best is None:
                best = _Best(k)
                uids, anchor_ids, labels = (np.concatenate([r.column(c).to_numpy() for r in held] or [np.zeros(0, np.int64)]) for c in ("uid", "id", "label"))
                vectors = np.concatenate([_vectors(r.column("vector"), dims, scale) for r in held] or [np.zeros((0, dims))])
                carried = [x for r in held for x in r.column("carried").to_pylist()]
            (ids, none), label, block = _ids(rows), rows.column("label").to_numpy(), _vectors(rows.column("vector"), dims, scale)
            for i in range(len(uids)):
                found = scores(block, vectors[i])
                order = sorted_by_score(found, ids, none)
                order = order[label[order] != labels[i]]
                rising = found[order][::-1]
                for place, positive in enumerate(carried[i]):
                    most, least = high * positive["score"] // 100, -(-low * positive["score"] // 100)
                    start = len(rising) - int(np.searchsorted(rising, most, side="right"))
                    end = len(rising) - int(np.searchsorted(rising, least, side="left"))
                    near = order[start : min(end, start + k)]
                    best.add(i, place, found[near], ids[near], none[near])
        if best:
            yield result(best, uids, anchor_ids, carried)

    return cells.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _first(rows: DataFrame, by: list[str], score: str, key: str, k: int, out: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.col(key).isNull(), key)  # up to k rows for each cell
    return rows.withColumn(out, F.row_number().over(order)).where(F.col(out) <= k)


def mine(
    table: DataFrame,
    asks: Column,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    n_positives: int = 5,
    k: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    asks: which rows are anchors. A negative's score lies from `low` to `high` per cent of its
    positive's.
    """
    fields = [F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector")]
    # Numbered once, so that a row is known again among rows of the same id.
    rows = written(table.where(usable(table, label, vector)).select(F.monotonically_increasing_id().alias("uid"), *fields, F.coalesce(asks, F.lit(False)).alias("anchor")))
    anchors = rows.where("anchor")
    seen = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("vector")).alias("dims")).first()
    dims = max(1, seen["dims"] or 0)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    teams = max(1, -(-seen["anchors"] * 8 * dims // TEAM_BYTES))
    chunks = max(-(-seen["n"] // CHUNK_ROWS), -(-parts // teams))
    near = positives(_cells(rows, anchors, F.lit(None).cast("int"), teams, chunks), dims, n_positives, scale)
    near = _first(near, ["uid"], "score", "id", n_positives, "place")
    limits = near.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("positives"))  # n_positives rows
    asking = written(anchors.join(limits, "uid"))
    hard = negatives(_cells(rows, asking, F.col("positives"), teams, chunks), dims, k, scale, low, high)
    ranked = _first(hard, ["uid", "place"], "negative_score", "negative_id", k, "rank")
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
