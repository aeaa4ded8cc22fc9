"""Intervals by resampling groups: lift, paired differences, risk ceilings and what they say.

Captures of one pass share a receiver and a geometry, so groups are drawn and not rows. A
draw gives each group a Poisson(1) weight from a digest of seed, draw and group, which any
engine can repeat and which needs no list of groups; a digest serves four draws. Rows are
summed up by group first; what a draw then costs is one weight and a few additions for each
group, combined where the groups are, so a draw is one row of the exchange for each task. Digests are made for many groups at once (functions/digests.py).

An end of an interval is resolved if at least DRAWS_PER_TAIL draws lie beyond it.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlane.functions.digests import MOST_BYTES, md5_words
from reviewlane.functions.materialize import checkpoint, written
from reviewlane.functions.ranking import PART, first_rows, in_order
from reviewlane.operators.metrics import bin_edges, intraclass, verdict

# The bar for lift, the level of intervals and how many comparisons share it.
LIFT_BAR, ALPHA, COMPARISONS = 1.5, 0.05, 5
DRAWS_PER_TAIL = 20  # fixed value
AT_ONCE = 4  # draws that one digest serves, each by 8 of its hexadecimal digits
HELD_GROUPS = 4096  # groups whose weights in all draws a task holds
DIGESTS = 32768  # made at once


def draws_needed(alpha: float = ALPHA, comparisons: int = COMPARISONS) -> int:
    """How many draws resolve the ends of an interval at the level of one of several comparisons (O11.9)."""
    return math.ceil(round(2 * DRAWS_PER_TAIL * comparisons / alpha, 6))


def poisson_bars(n: int = 10) -> list[int]:
    """From which 32-bit number on a digest stands for 1, 2, ... copies: the Poisson(1) distribution, rounded down."""
    bars, below = [], 0.0
    for k in range(n):
        below += math.exp(-1) / math.factorial(k)
        bars.append(int(below * (1 << 32)))
    return bars


def _digest(group: Column, block: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), block.cast("string"), F.coalesce(group.cast("string"), F.lit(""))))


def _copies(digits: Column) -> Column:
    """Digits of one length in lower case have the order of their numbers."""
    return reduce(lambda a, b: a + b, (F.when(digits >= f"{bar:08x}", 1).otherwise(0) for bar in poisson_bars()))


def weight(group: Column, draw: Column, seed: int) -> Column:
    """How often the draw holds the group."""
    digest = _digest(group, F.floor(draw / AT_ONCE).cast("int"), seed)
    return _copies(F.substring(digest, (F.pmod(draw, F.lit(AT_ONCE)) * 8 + 1).cast("int"), F.lit(8)))


def draw_weights(group: str, draws: int, seed: int) -> np.ndarray:
    """weight() of one group, as text, in all draws."""
    digests = b"".join(hashlib.md5(f"{seed}:{i}:{group}".encode()).digest() for i in range(-(-draws // AT_ONCE)))
    return np.searchsorted(poisson_bars(), np.frombuffer(digests, ">u4")[:draws].astype(np.int64), side="right")


def weights_of(groups: list[str], draws: int, seed: int) -> np.ndarray:
    """draw_weights() of each group, a row of bytes each; groups too long for one block of MD5 are digested one by one."""
    out = np.zeros((len(groups), draws), np.uint8)
    texts, prefixes = [g.encode() for g in groups], [f"{seed}:{i}:".encode() for i in range(-(-draws // AT_ONCE))]
    fits = np.array([len(prefixes[-1]) + len(t) <= MOST_BYTES for t in texts], bool)
    for i in np.flatnonzero(~fits).tolist():
        out[i] = draw_weights(groups[i], draws, seed)
    short = [t for t, f in zip(texts, fits) if f]
    if not short:
        return out
    held, bars, at = np.zeros((len(short), len(prefixes) * AT_ONCE), np.uint8), poisson_bars(), 0
    while at < len(prefixes):
        end = min(len(prefixes), at + max(1, DIGESTS // len(short)))
        end = next((i for i in range(at, end) if len(prefixes[i]) != len(prefixes[at])), end)
        for i, word in enumerate(md5_words(prefixes[at:end], short)):
            number, copies = word.byteswap(), np.zeros(word.shape, np.uint8)
            for bar in bars:
                copies += number >= np.uint32(bar)
            held[:, at * AT_ONCE + i : end * AT_ONCE : AT_ONCE] = copies.T
        at = end
    out[fits] = held[:, :draws]
    return out


def drawn(groups: DataFrame, group: str, draws: int, seed: int) -> DataFrame:
    """groups with `draw` and `copies`, a row for each draw that holds the group."""
    blocks = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // AT_ONCE))).alias("block"))
    hashed = blocks.withColumn("digest", _digest(F.col(group), F.col("block"), seed))
    each = (F.struct((F.col("block") * AT_ONCE + i).alias("draw"), _copies(F.substring("digest", 8 * i + 1, 8)).alias("copies")) for i in range(AT_ONCE))
    return hashed.select(*groups.columns, F.explode(F.array(*each)).alias("d")).select(*groups.columns, "d.*").where(f"copies > 0 and draw < {draws}")


def _totals(weights: np.ndarray, values: np.ndarray) -> np.ndarray:
    """weights.T @ values in whole numbers: doubles hold what 256 rows add up to, for values in two parts of 32 bits."""
    parts = [(values & 0xFFFFFFFF, 0)] + [(values >> 32, 32)] * bool((values >> 32).any())
    out = np.zeros((weights.shape[1], values.shape[1]), np.int64)
    for at in range(0, len(values), 256):
        few = weights[at : at + 256].T.astype(float)
        for part, shift in parts:
            out += (few @ part[at : at + 256].astype(float)).astype(np.int64) << shift
    return out


def resampled(rows: DataFrame, group: str, sums: dict[str, Column], draws: int, seed: int, by: list[str] = ()) -> DataFrame:
    """draw, by and the weighted sum of each column, whole numbers; draws that hold no group are left out.

    A group is one row, with a cell for each value of `by`, so its weights are made once. A
    task adds up its groups for all draws at once and gives a row for each draw and value of
    `by`, of which there should be few.
    """
    by, names = list(by), list(sums)
    named = rows.withColumn("name of group", F.coalesce(F.col(group).cast("string"), F.lit("")))
    cells = named.groupBy("name of group", *by).agg(*(F.sum(c).cast("long").alias(name) for name, c in sums.items()))
    groups = cells.groupBy("name of group").agg(F.collect_list(F.struct(*by, *names)).alias("cells"))
    schema = cells.select(F.lit(0).alias("draw"), *by, *names).schema

    def run(batches):
        totals, kinds = {}, []
        for batch in batches:
            kinds = [batch.column("cells").type.value_type.field(c).type for c in by]
            texts = batch.column("name of group").to_pylist()
            size = -(-len(texts) // max(1, -(-len(texts) // HELD_GROUPS)))
            for at in range(0, len(texts), max(1, size)):
                lists = batch.column("cells").slice(at, size)
                weights = weights_of(texts[at : at + size], draws, seed)
                owner, flat = lists.value_parent_indices().to_numpy(), lists.flatten()
                values = np.stack([flat.field(c).fill_null(0).to_numpy() for c in names] + [np.ones(len(flat), np.int64)], axis=1)
                places = np.zeros(len(flat), np.int64)
                for c in by:
                    codes = flat.field(c).dictionary_encode("encode").indices.to_numpy()
                    places = np.unique(places * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
                order = np.argsort(places, kind="stable")
                for mine in np.split(order, np.flatnonzero(np.diff(places[order])) + 1):
                    key = tuple(flat.field(c)[int(mine[0])].as_py() for c in by)
                    found = _totals(weights[owner[mine]], values[mine])
                    totals[key] = totals[key] + found if key in totals else found
        for key, total in totals.items():
            held = np.flatnonzero(total[:, -1])
            columns = [pa.array(held.astype(np.int32)), *(pa.array([k] * len(held), kind) for k, kind in zip(key, kinds)), *(pa.array(total[held, i]) for i in range(len(names)))]
            yield pa.RecordBatch.from_arrays(columns, ["draw", *by, *names])

    # A few bytes of a group are much work, so Spark must not put them into few partitions; each partition gives a row for each draw.
    parts = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return groups.repartition(parts, "name of group").mapInArrow(run, schema).groupBy("draw", *by).agg(*(F.sum(name).alias(name) for name in names))


def interval(values: DataFrame, value: str, by: list[str] = (), alpha: float = ALPHA) -> DataFrame:
    """by, draws, low, middle, high, low and high again for one of COMPARISONS, and whether their ends are resolved; values has one row a draw."""
    part = alpha / COMPARISONS
    at = {"low": alpha / 2, "middle": 0.5, "high": 1 - alpha / 2, "low_adjusted": part / 2, "high_adjusted": 1 - part / 2}
    shares = F.array(*map(F.lit, at.values()))
    found = values.groupBy(*by).agg(F.count(value).cast("long").alias("draws"), F.percentile(value, shares).alias("q"))
    resolved = [(F.col("draws") * level >= 2 * DRAWS_PER_TAIL - 1e-9).alias(name) for name, level in (("resolved", alpha), ("resolved_adjusted", part))]
    return found.select(*by, "draws", *(F.get("q", F.lit(i)).alias(name) for i, name in enumerate(at)), *resolved)


def direction(low: Column, high: Column) -> Column:
    """Which side an interval of a difference is on (O11.6)."""
    return F.when(low > 0, "challenger_better").when(high < 0, "reference_better").otherwise("indistinguishable")


def united(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """rows (grouping, low, high, ...) with one more, `union`, for each key: the least low and the largest high govern (O11.8, O9.5)."""
    lower, upper = ("low", "low_adjusted", "resolved", "resolved_adjusted"), ("high", "high_adjusted")
    least, most = [F.min(c).alias(c) for c in lower], [F.max(c).alias(c) for c in upper]
    rest = [F.max(c).alias(c) for c in rows.columns if c not in ("grouping", *lower, *upper, *keys)]
    return rows.unionByName(rows.groupBy(*keys).agg(*least, *most, *rest).withColumn("grouping", F.lit("union")))


def paired_difference(rows: DataFrame, groupings: list[str], draws: int = 1000, seed: int = 42) -> DataFrame:
    """grouping, margin, interval and direction of the Brier gain of p over the share of y (O11.6, O11.8, O11.9).

    Differences are whole billionths, so sums do not depend on the order of rows. The last
    row is the union of all groupings, and its interval governs.
    """
    prior = rows.agg(F.avg("y").alias("r")).first()["r"]
    gain = F.pow(F.lit(prior) - F.col("y"), 2) - F.pow(F.col("p") - F.col("y"), 2)
    judged = checkpoint(rows.select(*groupings, F.round(gain * 1e9).cast("long").alias("gain")))
    out = None
    for grouping in groupings:
        drawn = resampled(judged, grouping, {"gain": F.col("gain"), "n": F.lit(1)}, draws, seed)
        one = interval(drawn.withColumn("mean", F.col("gain") / F.col("n") / 1e9), "mean").withColumn("grouping", F.lit(grouping))
        out = one if out is None else out.unionByName(one)
    whole = judged.agg((F.sum("gain") / F.count("*") / 1e9).alias("margin"), F.count("*").alias("n"))
    joined = united(out).crossJoin(F.broadcast(whole))  # one row
    return joined.withColumn("direction", direction(F.col("low"), F.col("high"))).withColumn(
        "direction_adjusted", direction(F.col("low_adjusted"), F.col("high_adjusted"))
    )


def risk_ceiling(rows: DataFrame, grouping: str, threshold: float, target: float, draws: int = 1000, seed: int = 42) -> DataFrame:
    """One row: kept, errors, risk and its interval among predictions as sure as the threshold; held if the upper end is in bounds (O11.11)."""
    sure = F.greatest(F.col("p"), 1 - F.col("p")) >= threshold
    wrong = ((F.col("p") >= 0.5).cast("int") != F.col("y")).cast("long")
    kept = checkpoint(rows.where(sure).select(grouping, wrong.alias("wrong")))
    drawn = resampled(kept, grouping, {"errors": F.col("wrong"), "kept": F.lit(1)}, draws, seed)
    found = interval(drawn.withColumn("risk", F.col("errors") / F.col("kept")), "risk")
    whole = kept.agg(F.count("*").alias("kept"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("errors"))
    joined = whole.join(F.broadcast(found))  # one row each
    return joined.withColumn("risk", F.col("errors") / F.when(F.col("kept") > 0, F.col("kept"))).withColumn("held", F.col("high") <= target)


def draw_budgets(rows: DataFrame, grouping: str, budget: int, draws: int, seed: int) -> DataFrame:
    """draw, n, conflicts and budget: the budget grows with what is drawn, rounded up in whole numbers."""
    total = rows.count()
    drawn = resampled(rows, grouping, {"n": F.lit(1), "conflicts": F.col("conflict").cast("long")}, draws, seed)
    scaled = F.ceil(F.col("n") * min(budget, total) / F.lit(float(max(total, 1))))
    return drawn.withColumn("budget", F.greatest(F.lit(1), F.least(F.col("n"), scaled)).cast("long"))


def found_in_draws(rows: DataFrame, order: str | list[str], budgets: DataFrame, grouping: str, draws: int, seed: int) -> DataFrame:
    """draw, found: conflicts among the first `budget` rows of each draw, by one or two columns ascending; the last is unique.

    A row drawn twice stands there twice. Only the head of the order is taken and weighted: it
    is doubled until it fills every draw's budget.
    """
    order = [order] if isinstance(order, str) else order
    total, most = rows.count(), budgets.agg(F.max("budget").alias("b")).first()["b"] or 1
    head = 2 * most + 64
    while True:
        first = first_rows(rows.select(*order, grouping, "conflict"), order, head)
        weighted = drawn(first.repartition(rows.sparkSession.sparkContext.defaultParallelism, order[-1]), grouping, draws, seed)
        within = Window.partitionBy("draw").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # some `head` rows a draw
        run = weighted.withColumn("before", F.sum("copies").over(within) - F.col("copies")).join(F.broadcast(budgets.select("draw", "budget")), "draw")  # one row a draw
        taken = F.greatest(F.lit(0), F.least(F.col("copies"), F.col("budget") - F.col("before")))
        found = run.groupBy("draw", "budget").agg(F.sum(F.col("conflict").cast("long") * taken).alias("found"), F.sum("copies").alias("held"))
        found = checkpoint(found)
        if head >= total or found.where("held < budget").isEmpty() and found.count() == budgets.count():
            return found.select("draw", "found")
        head *= 2


def _found_first(rows: DataFrame, order: list[str], budget: int) -> int:
    """Conflicts among the first `budget` rows."""
    return first_rows(rows.select(*order, "conflict"), order, budget).agg(F.sum(F.col("conflict").cast("long")).alias("f")).first()["f"] or 0


def lift_interval(rows: DataFrame, order: str | list[str], groupings: list[str], budget: int = 50, draws: int = 1000, seed: int = 42) -> DataFrame:
    """grouping, found, lift, its interval and verdict, with the union of all groupings last (O11.1, O11.2, O11.4, O11.5).

    rows: conflict, the grouping columns and the order's (one or two, the last is unique). Draws
    without a conflict have no lift; with fewer than a tenth (or 20) of the draws left, ends that
    are not resolved, or a point outside its own interval, nothing can be said.
    """
    order = [order] if isinstance(order, str) else order
    rows = written(rows.select(*order, "conflict", *groupings))
    whole = rows.agg(F.count("*").alias("n"), F.sum(F.col("conflict").cast("long")).alias("c")).first()
    n, conflicts, found = whole["n"], whole["c"] or 0, _found_first(rows, order, budget)
    chance = min(budget, n) * conflicts / n if n else 0.0
    point = F.lit(found / chance if chance else None).cast("double")
    out = None
    for grouping in groupings:
        budgets = checkpoint(draw_budgets(rows, grouping, budget, draws, seed))
        lifts = budgets.join(found_in_draws(rows, order, budgets, grouping, draws, seed), "draw").where("conflicts > 0")
        one = interval(lifts.withColumn("lift", F.col("found") * F.col("n") / (F.col("conflicts") * F.col("budget"))), "lift")
        out = one.withColumn("grouping", F.lit(grouping)) if out is None else out.unionByName(one.withColumn("grouping", F.lit(grouping)))
    slack = 1e-9 + 0.05 * (F.col("high") - F.col("low"))
    inside = (F.col("draws") >= max(20, draws // 10)) & F.col("resolved") & point.between(F.col("low") - slack, F.col("high") + slack)
    said = verdict(F.col("low"), F.col("high"), LIFT_BAR, F.coalesce(inside, F.lit(False)))
    return united(out).select("*", F.lit(found).cast("long").alias("found"), point.alias("lift"), said.alias("verdict"))


def ordering_differences(
    rows: DataFrame, orders: dict[str, list[str]], grouping: str, challenger: str, budget: int = 50, draws: int = 1000, seed: int = 42
) -> DataFrame:
    """ordering, difference and ratio of found conflicts to the challenger's, with intervals (O11.3).

    orders: by name, the columns by which rows go up (one or two, the last is unique). All are
    judged in the same draws. The ratio has half a conflict more on both sides.
    """
    rows = written(rows.select(*dict.fromkeys(c for order in orders.values() for c in order), "conflict", grouping))
    budgets = checkpoint(draw_budgets(rows, grouping, budget, draws, seed))
    found = {name: found_in_draws(rows, order, budgets, grouping, draws, seed) for name, order in orders.items()}
    points = {name: _found_first(rows, order, budget) for name, order in orders.items()}
    own, out = found.pop(challenger).withColumnRenamed("found", "own"), None
    for name, other in found.items():
        both = own.join(other, "draw").join(budgets, "draw").where("conflicts > 0")
        values = both.withColumn("difference", (F.col("own") - F.col("found")) * F.col("n") / (F.col("conflicts") * F.col("budget")))
        ratios = both.withColumn("ratio", (F.col("own") + 0.5) / (F.col("found") + 0.5))
        ratio = interval(ratios, "ratio").select(F.col("low_adjusted").alias("ratio_low"), F.col("high_adjusted").alias("ratio_high"))
        one = interval(values, "difference").join(F.broadcast(ratio)).withColumn("ordering", F.lit(name))  # one row each
        one = one.withColumn("more_found", F.lit(points[challenger] - points[name]).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("direction", direction(F.col("low_adjusted"), F.col("high_adjusted")))


def permutation_tail(found: Column, n: Column, conflicts: Column, budget: Column) -> Column:
    """The chance that a random order finds as many conflicts in its first `budget` rows: the hypergeometric tail (O11.18).

    Its logarithms are summed up term by term, for the at most `budget` counts that are as large.
    """
    def log_choose(a, b):
        steps = F.sequence(F.lit(1), F.greatest(b, F.lit(1)).cast("int"))
        total = F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.log((a - b + i) / i.cast("double")))
        return F.when(b <= 0, F.lit(0.0)).otherwise(total)

    def term(k):
        possible = (k <= conflicts) & (budget - k <= n - conflicts)
        return F.when(possible, F.exp(log_choose(conflicts, k) + log_choose(n - conflicts, budget - k) - log_choose(n, budget))).otherwise(0.0)

    return F.aggregate(F.sequence(found.cast("int"), budget.cast("int")), F.lit(0.0), lambda s, k: s + term(k))


SAMPLE = -1  # the number of the draw that is the sample itself
FEW_VALUES = 1024  # up to so many distinct predictions, a task holds the sums of each in all draws


def _stacked(rows: DataFrame, predictions: list[str], y: str, group: str) -> DataFrame:
    """of (which prediction), p, y, group: a row for each prediction of a row."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("of"), F.col(p).alias("p")) for i, p in enumerate(predictions)))).alias("s")
    return rows.select(each, F.col(y).cast("long").alias("y"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("group")).select("s.*", "y", "group")


def auc_in_draws(rows: DataFrame, predictions: list[str], y: str, group: str, draws: int, seed: int) -> DataFrame:
    """draw, of, value: the area under the ROC curve in every draw and in the sample; null where a draw lacks a class (O11.7).

    Where predictions have up to FEW_VALUES values, the weights of ones and zeros are summed up
    by value and draw, and pairs in the right order (ties count half) are counted from these
    sums. More values are dealt into partitions that follow one another.
    """
    stacked = checkpoint(_stacked(rows, predictions, y, group))
    if stacked.select("of", "p").distinct().limit(FEW_VALUES + 1).count() > FEW_VALUES:
        pieces = (_auc_of_many(stacked.where(F.col("of") == i), draws, seed).withColumn("of", F.lit(i)) for i in range(len(predictions)))
        return reduce(DataFrame.unionByName, pieces)
    sums = {"ones": F.col("y"), "zeros": 1 - F.col("y")}
    sample = stacked.groupBy("of", "p").agg(*(F.sum(c).alias(name) for name, c in sums.items())).withColumn("draw", F.lit(SAMPLE))
    every = resampled(stacked, "group", sums, draws, seed, ["of", "p"]).unionByName(sample)
    before = F.sum("zeros").over(Window.partitionBy("draw", "of").orderBy("p")) - F.col("zeros")  # a row for each value
    return _areas(every.withColumn("pairs", F.col("ones") * (2 * before + F.col("zeros"))), "draw", "of")


def _areas(sums: DataFrame, *by: str) -> DataFrame:
    whole = sums.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("ones", "zeros", "pairs")))
    defined = (F.col("ones") > 0) & (F.col("zeros") > 0)
    return whole.select(*by, F.when(defined, F.col("pairs") / (2.0 * F.col("ones") * F.col("zeros"))).alias("value"))


def _auc_of_many(rows: DataFrame, draws: int, seed: int) -> DataFrame:
    """draw, value for rows (p, y, group) with any number of values of p.

    Rows are counted by prediction and group and dealt into partitions in order of prediction.
    A task keeps, for all draws at once, the weights of ones and zeros and the weight of pairs
    in the right order among its own rows; what a partition's ones owe to the zeros of the
    partitions before is added afterwards from one row a partition and draw. A group's weights
    are made for each of its predictions, and rows of one prediction are one task's.
    """
    counts = rows.groupBy("p", "group").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    dealt = in_order(counts, ["p"]).select(F.col(PART).cast("int").alias("part"), "p", "group", "n1", "n0")

    def run(batches):
        at, part = None, 0
        ones, zeros, pairs, here1, here0 = (np.zeros(draws + 1, np.int64) for _ in range(5))
        for batch in (b.slice(i, HELD_GROUPS) for b in batches for i in range(0, b.num_rows, HELD_GROUPS)):
            weights = np.c_[weights_of(batch.column("group").to_pylist(), draws, seed), np.ones(batch.num_rows, np.uint8)]
            for i, (part, value, n1, n0) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "p", "n1", "n0")))):
                if value != at:
                    pairs += here1 * (2 * zeros + here0)
                    ones, zeros = ones + here1, zeros + here0
                    here1, here0, at = np.zeros(draws + 1, np.int64), np.zeros(draws + 1, np.int64), value
                for here, n in ((here1, n1), (here0, n0)):
                    if n:
                        here += np.int64(n) * weights[i]
        pairs += here1 * (2 * zeros + here0)
        columns = [pa.array(np.append(np.arange(draws), SAMPLE).astype(np.int32)), pa.array(np.full(draws + 1, part, np.int32)), *map(pa.array, (ones + here1, zeros + here0, pairs))]
        yield pa.RecordBatch.from_arrays(columns, ["draw", "part", "ones", "zeros", "pairs"])

    parts = dealt.sortWithinPartitions("p").mapInArrow(run, "draw int, part int, ones long, zeros long, pairs long")
    before = F.sum("zeros").over(Window.partitionBy("draw").orderBy("part")) - F.col("zeros")  # a row for each partition
    return _areas(parts.withColumn("pairs", F.col("pairs") + 2 * F.col("ones") * before), "draw")


def calibration_error_in_draws(rows: DataFrame, predictions: list[str], y: str, group: str, draws: int, seed: int, bins: int = 10) -> DataFrame:
    """draw, of, value: the expected calibration error in every draw and in the sample (O11.7); predictions count in billionths."""
    place = sum((F.when(F.col("p") >= e, 1).otherwise(0) for e in bin_edges(bins)[1:-1]), F.lit(0))
    binned = _stacked(rows, predictions, y, group).select("group", "of", place.alias("bin"), F.round(F.col("p") * 1e9).cast("long").alias("p"), "y")
    sums = {"p": F.col("p"), "y": F.col("y"), "n": F.lit(1)}
    sample = binned.groupBy("of", "bin").agg(*(F.sum(c).alias(name) for name, c in sums.items())).withColumn("draw", F.lit(SAMPLE))
    every = resampled(binned, "group", sums, draws, seed, ["of", "bin"]).unionByName(sample)
    gap = F.abs(F.col("p") - F.col("y") * 1_000_000_000)
    return every.groupBy("draw", "of").agg((F.sum(gap) / F.sum("n") / 1e9).alias("value"))


#: By name: the statistic in draws, and whether less is better.
STATISTICS = {"auc": (auc_in_draws, False), "calibration_error": (calibration_error_in_draws, True)}


def statistic_difference(
    rows: DataFrame, statistic: str, challenger: str, reference: str, y: str, groupings: list[str], draws: int | None = None, seed: int = 42
) -> DataFrame:
    """grouping, margin, its interval, draws, undefined and directions: how much better the challenger's statistic is (O11.7).

    A positive margin speaks for the challenger, whichever way the statistic runs. Draws in
    which a statistic is not defined are counted and left out; with fewer than a tenth (or 20)
    left nothing can be measured. The last row is the union of the groupings and governs.
    """
    measure, less = STATISTICS[statistic]
    draws, sign = draws or draws_needed(), 1 if less else -1
    rows, out = checkpoint(rows.select(challenger, reference, y, *groupings)), None
    for grouping in groupings:
        each = measure(rows, [challenger, reference], y, grouping, draws, seed)
        mine, its = (F.max(F.when(F.col("of") == i, F.col("value"))) for i in (0, 1))
        both = checkpoint(each.groupBy("draw").agg((sign * (its - mine)).alias("margin")))
        point = both.where(F.col("draw") == SAMPLE).select(F.col("margin").alias("margin of sample"))
        values = both.where(F.col("draw") != SAMPLE)
        one = interval(values, "margin").join(F.broadcast(point))  # one row each
        one = one.select(F.lit(grouping).alias("grouping"), F.col("margin of sample").alias("margin"), *(c for c in one.columns if c != "margin of sample"))
        out = one if out is None else out.unionByName(one)
    usable = F.col("draws") >= max(20, draws // 10)
    said = lambda low, high: F.when(usable, direction(F.col(low), F.col(high))).otherwise("unmeasurable")
    return united(out.withColumn("undefined", draws - F.col("draws"))).withColumns({"direction": said("low", "high"), "direction_adjusted": said("low_adjusted", "high_adjusted")})


def clustering(rows: DataFrame, value: str, groupings: list[str]) -> DataFrame:
    """grouping, label, k, n, n0, icc and design_effect of each grouping; the label says what resampling it amounts to (O6.6).

    A grouping with one row in each group is resampling by observation, whatever its name.
    """
    out = None
    for grouping in groupings:
        one = intraclass(rows.where(F.col(value).isNotNull()), grouping, value)
        label = F.when(F.col("icc").isNotNull(), grouping).when(F.col("n") == F.col("k"), "observation_level").otherwise(f"{grouping}_unmeasurable")
        one = one.select(F.lit(grouping).alias("grouping"), label.alias("label"), *one.columns)
        out = one if out is None else out.unionByName(one)
    return out
