"""The review queue: reasons, composite score, episode deduplication, baselines and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlane.functions.materialize import attach, checkpoint, written
from reviewlane.functions.ranking import positions, running_total
from reviewlane.functions.records import ceil_share, confidence

# Thresholds of the criteria and weights of the score.
PROB_HIGH, PROB_LOW, OFFSET_PPM, FLAT_ROWS = 0.75, 0.25, 20.0, 0.15
WEIGHTS = {"disagreement": 0.40, "safe_offset": 0.35, "flat_rank": 0.15, "uncertainty": 0.10}
ACTIONABLE = ["MODEL_LABEL_DISAGREE", "STALE_CATALOGUE_FREQ", "DEAD_CAPTURE"]


def reasons(label: Column, prob: Column, offset: Column, at_bound: Column, flat: Column) -> Column:
    """The codes that apply, in fixed order; NO_REASON if none does; nulls never fire (O4.2)."""
    disagree = ((label == "without-signal") & (prob >= PROB_HIGH)) | ((label == "with-signal") & (prob <= PROB_LOW))
    fired = F.array_compact(
        F.array(
            F.when(disagree, ACTIONABLE[0]),
            F.when(~at_bound & (F.abs(offset) >= OFFSET_PPM), ACTIONABLE[1]),
            F.when(flat >= FLAT_ROWS, ACTIONABLE[2]),
            F.when(at_bound, "OFFSET_AT_BOUND"),
        )
    )
    return F.when(F.size(fired) == 0, F.array(F.lit("NO_REASON"))).otherwise(fired)


def is_conflict(codes: Column) -> Column:
    return F.arrays_overlap(codes, F.array(*map(F.lit, ACTIONABLE)))


def disagreement(label: Column, prob: Column) -> Column:
    """How far the model is from the label; without a label, how sure it is; null prob is 0."""
    known = F.when(label == "with-signal", 1.0 - prob).when(label == "without-signal", prob).otherwise(F.abs(prob - 0.5) * 2.0)
    return F.coalesce(known, F.lit(0.0))


def normalised_ranks(rows: DataFrame, values: list[str]) -> DataFrame:
    """signal, value, share: for each column its values' average ranks over the number of rows (O7.1).

    All columns are counted in one pass and ranked together; rows has been written down.
    """
    stacked = F.explode(F.array(*(F.struct(F.lit(c).alias("signal"), F.col(c).alias("value")) for c in values))).alias("s")
    counts = rows.select(stacked).groupBy("s.signal", "s.value").agg(F.count("*").alias("k"))
    placed = checkpoint(running_total(counts, ["signal"], ["value"], "k", "before"))
    total = placed.where(F.col("signal") == values[0]).agg(F.sum("k").alias("n")).first()["n"] or 1
    return placed.select("signal", "value", ((F.col("before") + (F.col("k") + 1) / 2.0) / float(total)).alias("share"))


def finite_signals(rows: DataFrame, values: list[str]) -> DataFrame:
    """NaN and null take the column's least finite value, or 0 if there is none."""
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in values}
    least = rows.agg(*(F.min(x).alias(c) for c, x in clean.items())).first()
    return rows.withColumns({c: F.coalesce(x, F.lit(0.0 if least[c] is None else float(least[c]))) for c, x in clean.items()})


def scored(candidates: DataFrame) -> DataFrame:
    """candidates with reasons, conflict and the composite score (O8.7)."""
    signals = {
        "disagreement": disagreement(F.col("label"), F.col("prob")),
        "safe_offset": F.when(F.col("at_bound"), 0.0).otherwise(F.coalesce(F.abs("offset_ppm"), F.lit(0.0))),
        "flat_rank": F.coalesce("flat", F.lit(0.0)),
        "uncertainty": F.coalesce("spread", F.lit(0.0)),
    }
    # Written down once: four signals are ranked and joined back, and callers order the result several ways.
    rows = written(candidates.withColumns(signals))
    rows = finite_signals(rows, list(signals))
    ranks = checkpoint(normalised_ranks(rows, list(signals)))
    for name in signals:
        one = ranks.where(F.col("signal") == name).select(F.col("value").alias(name), F.col("share").alias(f"share of {name}"))
        rows = attach(rows, one, [name])
    score = sum((F.col(f"share of {name}") * weight for name, weight in list(WEIGHTS.items())[1:]), F.col("share of disagreement") * WEIGHTS["disagreement"])
    codes = reasons(*(F.col(c) for c in ("label", "prob", "offset_ppm", "at_bound", "flat")))
    return (
        rows.withColumn("score", F.round(score, 9))
        .withColumn("reasons", codes)
        .withColumn("conflict", is_conflict(F.col("reasons")))
        .drop(*signals)
        .withColumnsRenamed({f"share of {name}": name for name in signals})
    )


def best_of_episode(scored_rows: DataFrame, keep: list[str]) -> DataFrame:
    """Of each episode the row with the highest score, then the lower id (O7.2), by an aggregate that combines early."""
    best = F.max(F.struct("score", (-F.col("obs_id")).alias("_neg"), *keep)).alias("b")
    return scored_rows.groupBy("episode").agg(best).select(
        "episode", (-F.col("b._neg")).alias("obs_id"), "b.score", *(f"b.{c}" for c in keep)
    )


def ranked(queue: DataFrame, out: str = "rank") -> DataFrame:
    """queue with its place from 1 by score descending, then id (O8.1)."""
    placed = positions(queue.withColumn("negated score", -F.col("score")), "negated score", "obs_id", out)
    return placed.withColumn(out, F.col(out) + 1).drop("negated score")


def top(queue: DataFrame, budget: int = 50) -> DataFrame:
    """The first `budget` rows with their rank; no total sort is needed (O8.13)."""
    first = queue.orderBy(F.desc("score"), "obs_id").limit(budget)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "obs_id")))


#: The orderings that a queue is compared with (O8.3 to O8.6): a value by which rows go up, ties by id.
BASELINES = {
    "fifo": None,
    "confidence": lambda: -F.coalesce(confidence(F.col("prob")), F.lit(0.0)),
    "physics": lambda: -F.coalesce(F.abs("offset_ppm"), F.lit(-1.0)),
    "offset": lambda: -F.when(F.col("at_bound"), 0.0).otherwise(F.coalesce(F.abs("offset_ppm"), F.lit(0.0))),
}


def found_at_budget(rows: DataFrame, budget: int) -> DataFrame:
    """One row per ordering: conflicts among its first `budget` rows and the point lift over chance (O11.1, O11.5)."""
    rows = checkpoint(rows)
    whole = rows.agg(F.count("*").alias("n"), F.sum(F.col("conflict").cast("int")).alias("conflicts")).first()
    n, conflicts = whole["n"], whole["conflicts"] or 0
    orders = {"queue": -F.col("score")} | {name: value() if value else F.lit(0.0) for name, value in BASELINES.items()}
    parts = None
    for name, value in orders.items():
        first = rows.select(value.alias("v"), "obs_id", "conflict").orderBy("v", "obs_id").limit(budget)
        one = first.agg(F.coalesce(F.sum(F.col("conflict").cast("int")), F.lit(0)).cast("long").alias("found")).withColumn("ordering", F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
    chance = min(budget, n) * conflicts / n if n else 0.0
    lift = F.round(F.col("found") / chance, 9) if chance else F.lit(None).cast("double")
    return parts.select("ordering", "found", F.lit(n).cast("long").alias("n"), F.lit(conflicts).cast("long").alias("conflicts"), lift.alias("lift"))


def apply_caps(queue: DataFrame, budget: int = 50, station_percent: int = 10, transmitter_percent: int = 20) -> DataFrame:
    """queue (rank, obs_id, station, transmitter, ...) with admitted, by_station, by_transmitter (O8.2).

    Greedy down the ranking: a row whose station or transmitter has filled its share of the
    budget is displaced; an unknown entity is its own. Once an entity is full it stays full,
    so a row is blocked exactly if it ranks below the admission that filled its station or
    transmitter. The pass looks at the best rows of entities that are not full, `window` at
    a time: at most budget rows are admitted, so at most budget windows reach the driver,
    and the labels of all rows come from a join with the filled entities.
    """
    quota = {"station": ceil_share(station_percent, budget), "transmitter": ceil_share(transmitter_percent, budget)}
    window, last = 20 * budget, 0
    counts: dict[str, dict] = {name: {} for name in quota}
    full: dict[str, dict] = {name: {} for name in quota}
    admitted: list[int] = []
    while len(admitted) < budget:
        open_rows = queue.where(F.col("rank") > last)
        for name, filled in full.items():
            if filled:
                open_rows = open_rows.where(F.col(name).isNull() | ~F.col(name).isin(list(filled)))
        rows = open_rows.select("rank", "obs_id", *quota).orderBy("rank").limit(window).collect()  # `window` rows
        if not rows:
            break
        for r in rows:
            last = r["rank"]
            if any(r[name] in full[name] for name in quota):
                continue
            admitted.append(r["obs_id"])
            for name in quota:
                if r[name] is not None:
                    counts[name][r[name]] = counts[name].get(r[name], 0) + 1
                    if counts[name][r[name]] == quota[name]:
                        full[name][r[name]] = r["rank"]
            if len(admitted) == budget:
                break
    end = last if len(admitted) == budget else None  # from here on rows are displaced without a cause
    out = queue.withColumn("admitted", F.col("obs_id").isin(admitted) if admitted else F.lit(False))
    for name, filled in full.items():
        at = F.lit(None).cast("long")
        for entity, rank in filled.items():  # at most budget / quota entities
            at = F.when(F.col(name) == F.lit(entity), F.lit(rank)).otherwise(at)
        blocked = F.col("rank") > at
        if end is not None:
            blocked = blocked & (F.col("rank") < end)
        out = out.withColumn(f"by_{name}", F.coalesce(blocked, F.lit(False)))
    return out
