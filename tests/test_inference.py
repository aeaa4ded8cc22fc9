"""Resampling, labels, chains, novelty and samples on small tables with known answers."""

import hashlib
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlane.functions import ranking
from reviewlane.functions.materialize import shared_folder
from reviewlane.functions.ranking import average_rank, percentiles, positions, running_max, running_total
from reviewlane.operators import inference, novelty, precedent, provenance, samples
from reviewlane.plans import inference as queries


def test_weights_are_poisson(spark):
    w = spark.range(20_000).select(inference.weight(F.col("id"), F.lit(3), 42).alias("w"))
    counts = {r["w"]: r["n"] for r in w.groupBy("w").agg(F.count("*").alias("n")).collect()}
    for k in range(4):
        assert counts[k] / 20_000 == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.012)
    again = spark.range(20_000).select(inference.weight(F.col("id"), F.lit(3), 42).alias("w"))
    assert w.agg(F.sum("w")).first() == again.agg(F.sum("w")).first()


def test_found_in_draws_counts_copies(spark):
    """Two rows of one group that is drawn twice fill the budget before the next row."""
    rows = spark.createDataFrame([(i, f"g{i // 2}", i % 3 == 0) for i in range(60)], "place long, grp string, conflict boolean")
    budgets = inference.draw_budgets(rows, "grp", 7, 30, 1)
    found = {r["draw"]: r["found"] for r in inference.found_in_draws(rows, "place", budgets, "grp", 30, 1).collect()}
    of = {r["g"]: r["w"] for r in spark.createDataFrame([(f"g{g}:{d}", f"g{g}", d) for g in range(30) for d in range(30)], "g string, grp string, d int").select("g", inference.weight(F.col("grp"), F.col("d"), 1).alias("w")).collect()}
    for b in budgets.collect():
        copies = [(i % 3 == 0) for i in range(60) for _ in range(of[f"g{i // 2}:{b.draw}"])]
        assert b.n == len(copies) and b.conflicts == sum(copies)
        assert b.budget == max(1, min(b.n, -(-7 * b.n // 60)))
        assert found[b.draw] == sum(copies[: b.budget])


def test_intervals_say_what_they_can(spark):
    none = spark.createDataFrame([(i, "g", False) for i in range(9)], "place long, grp string, conflict boolean")
    out = inference.lift_interval(none, "place", ["grp"], 3, 20).collect()
    assert {r.verdict for r in out} == {"NOT_MEASURABLE"} and {r.lift for r in out} == {None}
    all_ = spark.createDataFrame([(i, f"g{i}", i < 20) for i in range(200)], "place long, grp string, conflict boolean")
    out = {r.grouping: r for r in inference.lift_interval(all_, "place", ["grp"], 20, 100).collect()}
    assert {r.verdict for r in out.values()} == {"NOT_MEASURABLE"} and not any(r.resolved for r in out.values())  # 100 draws have 2.5 in a tail
    out = {r.grouping: r for r in inference.lift_interval(all_, "place", ["grp"], 20, 800).collect()}
    assert out["grp"].verdict == out["union"].verdict == "PASSED" and out["grp"].lift == 10.0 and out["grp"].resolved and not out["grp"].resolved_adjusted


def test_draws_and_weights_of_all_kinds_agree(spark):
    assert inference.draws_needed() == 4000 and inference.draws_needed(comparisons=1) == 800
    groups = spark.createDataFrame([("a",), ("ü b",), (None,)], "g string")
    by_draw = groups.select("g", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("draw")).select("g", "draw", inference.weight(F.col("g"), F.col("draw"), 7).alias("w")).collect()
    drawn = {(r.g, r.draw): r.copies for r in inference.drawn(groups, "g", 10, 7).collect()}
    for r in by_draw:
        assert drawn.get((r.g, r.draw), 0) == r.w == inference.draw_weights(r.g or "", 10, 7)[r.draw]


def rank_area(p, y, w):
    """AUC of weighted rows by comparing all pairs; nan without a class."""
    pairs = [(a, b, u * v) for a, i, u in zip(p, y, w) if i for b, j, v in zip(p, y, w) if not j]
    total = sum(u for *_, u in pairs)
    return sum(u * ((a > b) + (a == b) / 2) for a, b, u in pairs) / total if total else math.nan


def gap_of_bins(p, y, w):
    total = 0.0
    for k in range(10):
        at = [(a, b, u) for a, b, u in zip(p, y, w) if (a >= k / 10 if k else True) and (a < (k + 1) / 10 if k < 9 else True)]
        total += abs(sum(u * (a - b) for a, b, u in at))
    return total / sum(w) if sum(w) else math.nan


@pytest.mark.parametrize("statistic, of, sign", [("auc", rank_area, -1), ("calibration_error", gap_of_bins, 1)])
def test_statistics_in_draws(spark, statistic, of, sign):
    rng = np.random.default_rng(4)
    rows = [(float(rng.integers(0, 12)) / 12, float(rng.random()), int(rng.random() < 0.3), f"g{rng.integers(0, 9)}" if i % 2 else "hot", f"s{i % 3}") for i in range(60)]
    frame = spark.createDataFrame(rows, "p double, r double, y int, grp string, site string").repartition(5)
    out = {r.grouping: r for r in inference.statistic_difference(frame, statistic, "p", "r", "y", ["grp", "site"], 60, 3).collect()}
    p, r, y = ([x[i] for x in rows] for i in range(3))
    values = {}
    for k, name in ((3, "grp"), (4, "site")):
        weights = {g: inference.draw_weights(g, 60, 3) for g in {x[k] for x in rows}}
        margins = []
        for d in range(60):
            w = [int(weights[x[k]][d]) for x in rows]
            margins.append(sign * (of(r, y, w) - of(p, y, w)))
        values[name] = [m for m in margins if not math.isnan(m)]
        got = out[name]
        assert (got.draws, got.undefined) == (len(values[name]), 60 - len(values[name]))
        assert got.margin == pytest.approx(sign * (of(r, y, [1] * 60) - of(p, y, [1] * 60)), abs=1e-8)
        assert (got.low, got.high) == (pytest.approx(np.percentile(values[name], 2.5), abs=1e-8), pytest.approx(np.percentile(values[name], 97.5), abs=1e-8))
    assert out["union"].low == min(out["grp"].low, out["site"].low) and out["union"].high == max(out["grp"].high, out["site"].high)
    one = inference.statistic_difference(frame.where("y = 1"), "auc", "p", "r", "y", ["grp"], 60, 3).collect()
    assert {(x.direction, x.undefined, x.margin) for x in one} == {("unmeasurable", 60, None)}


def test_clustering_says_what_a_grouping_is(spark):
    rows = spark.createDataFrame([(i, i // 4, 0, float(i % 7 + i // 4)) for i in range(40)], "one int, four int, all int, v double")
    out = {r.grouping: r.label for r in inference.clustering(rows, "v", ["one", "four", "all"]).collect()}
    assert out == {"one": "observation_level", "four": "four", "all": "all_unmeasurable"}


@pytest.mark.parametrize("found, n, conflicts, budget", [(3, 20, 5, 6), (0, 20, 5, 6), (6, 20, 6, 6), (7, 20, 5, 6)])
def test_permutation_tail(spark, found, n, conflicts, budget):
    got = spark.range(1).select(inference.permutation_tail(*(F.lit(x).cast("long") for x in (found, n, conflicts, budget)))).first()[0]
    want = sum(math.comb(conflicts, k) * math.comb(n - conflicts, budget - k) for k in range(found, min(budget, conflicts) + 1)) / math.comb(n, budget)
    assert got == pytest.approx(want, abs=1e-12)


RECORDS = [
    (1, "good", "u", "with-signal"), (2, "good", "u", "without-signal"), (3, "good", "u", "unknown"), (4, "good", "u", None),
    (5, "good", None, "with-signal"), (6, "good", "", "without-signal"), (7, "failed", "u", "with-signal"), (8, None, "u", "with-signal"), (9, "future", None, "unknown"),
]


@pytest.fixture
def records(spark):
    return spark.createDataFrame([(*r, None, None) for r in RECORDS], "obs_id long, status string, url string, vetted string, ended timestamp, retrieved timestamp")


def test_labels(records):
    out = {r.obs_id: r for r in provenance.labelled(records).collect()}
    assert {i: (r.label_outcome, r.trace_presence, r.label_origin, r.artifact_status) for i, r in out.items()} == {
        1: ("positive", "unvetted", "satnogs_vet", "usable"),
        2: ("negative", "absent", "satnogs_vet", "usable"),
        3: ("unlabelled", "unvetted", "satnogs_unvet", "usable"),
        4: ("unlabelled", "unvetted", "satnogs_unvet", "usable"),
        5: ("unlabelled", "unknown", "missing", "missing"),
        6: ("unlabelled", "unknown", "missing", "missing"),
        7: ("positive", "unvetted", "satnogs_vet", "usable"),
        8: ("positive", "unvetted", "satnogs_vet", "usable"),
    }
    assert not any(provenance.broken_invariants(provenance.labelled(records)).first()[1:])
    broken = provenance.labelled(records).withColumn("label_outcome", F.lit("negative"))
    assert tuple(provenance.broken_invariants(broken).first()[1:]) == (3, 0, 2, 2)


def test_a_future_record_stops_the_query(records):
    with pytest.raises(Exception, match="future observation"):
        provenance.labelled(records, skip_future=False).collect()


def test_no_records_are_no_pass(spark):
    classes = spark.createDataFrame([("a", "identifier")], "field string, kind string")
    none = spark.createDataFrame([], "json string")
    with pytest.raises(Exception, match="no records"):
        provenance.classification(provenance.field_census(none, "json", classes)).collect()


def test_broken_links(spark):
    rows, prev = [], None
    for i in range(6):
        digest = hashlib.sha256(((prev or "") + f"r{i}").encode()).hexdigest()
        rows.append(("c", i, f"r{i}", prev, digest))
        prev = digest
    log = lambda x: spark.createDataFrame(x, "chain string, pos int, record string, prev string, digest string")
    assert tuple(provenance.broken_links(log(rows), "chain", "pos").first()) == ("c", 6, 0)
    changed = [(*r[:2], "other", *r[3:]) if r[1] == 2 else r for r in rows]
    assert tuple(provenance.broken_links(log(changed), "chain", "pos").first()) == ("c", 6, 1)
    assert tuple(provenance.broken_links(log(rows[:2] + rows[3:]), "chain", "pos").first()) == ("c", 5, 1)


def test_distances_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1e-4]])
    rows = [tuple(float(v) for v in r) for r in x]
    rows[5] = (None, float("nan"), rows[5][2])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, a double, b double, c double")
    model = novelty.Distances(df, ["a", "b", "c"])
    full = np.array([[np.nan if v is None else v for v in r] for r in rows], dtype=float)
    filled = np.where(np.isfinite(full), full, np.nanmedian(full, axis=0))
    cov = np.cov(filled, rowvar=False)
    inverse = np.linalg.pinv(cov + 1e-6 * np.trace(cov) / 3 * np.eye(3))
    away = filled - filled.mean(axis=0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", away, inverse, away))
    out = {r.id: r for r in model.score(df).collect()}
    assert [out[i].feature_distance for i in range(300)] == pytest.approx(want.tolist(), rel=1e-6)
    assert model.limit == pytest.approx(np.quantile(want, 0.99), rel=1e-6)
    assert sum(r.feature_novelty for r in out.values()) == 3 and out[5].a is None
    few = novelty.Distances(df.limit(5), ["a", "b", "c"])
    assert few.limit == float("inf") and not any(r.feature_novelty for r in few.score(df).collect())


def test_interpolation_equals_numpy(spark):
    rng = np.random.default_rng(1)
    xs, ys, at = np.unique(rng.integers(0, 1000, 40)), rng.normal(size=40), rng.integers(-50, 1100, 60)
    ys = ys[: len(xs)]
    series = spark.createDataFrame([("a", int(x), float(y)) for x, y in zip(xs, ys)], "g string, x long, y double")
    asked = spark.createDataFrame([("a", int(x)) for x in at] + [("none", 5)], "g string, x long")
    out = sorted((r.x, r.y) for r in novelty.interpolated(asked, series, "g", "x", "y").where("g = 'a'").collect())
    assert [y for _, y in out] == pytest.approx(np.interp(sorted(at), xs, ys).tolist())
    assert novelty.interpolated(asked, series, "g", "x", "y").where("g = 'none'").first().y is None


def test_orders_over_many_partitions(spark):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 30, 500)
    df = spark.createDataFrame([(i, int(v), "ab"[i % 2]) for i, v in enumerate(values)], "id long, v int, g string").repartition(7)
    placed = {r.id: r.at for r in positions(df, "v", "id", "at").collect()}
    assert [i for i, _ in sorted(placed.items(), key=lambda x: x[1])] == sorted(range(500), key=lambda i: (values[i], i))
    counts = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    for r in running_total(counts, ["g"], ["v"], "n", "before").collect():
        assert r.before == sum(1 for i, v in enumerate(values) if "ab"[i % 2] == r.g and v < r.v)
    for r in average_rank(df, "v", "r", ["g"]).collect():
        same = [v for i, v in enumerate(values) if "ab"[i % 2] == r.g]
        assert r.r == sum(v < r.v for v in same) + (sum(v == r.v for v in same) + 1) / 2
    for r in percentiles(df, "v", {"q": 0.3}, ["g"]).collect():
        assert r.q == pytest.approx(np.percentile([v for i, v in enumerate(values) if "ab"[i % 2] == r.g], 30))
    most = -1
    for r in sorted(running_max(df.select("id", "v"), "id", "v", "m").collect()):
        most = max(most, r.v)
        assert r.m == most


def test_samples(spark):
    df = spark.createDataFrame([(i, "abc"[min(i // 40, 2)], f"e{i % 9}", i % 7) for i in range(100)], "id long, label string, episode string, alt int")
    assert samples.random_rows(df, "id", 10, 1).count() == 10
    assert samples.random_rows(df, "id", 10, 1).select("id").subtract(samples.random_rows(df, "id", 10, 2).select("id")).count() > 0
    sizes = {r["label"]: r["n"] for r in samples.balanced(df, "label", "id", 30).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"a": 30, "b": 30, "c": 20}
    whole = samples.whole_groups(df, "episode", 25).groupBy("episode").agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in whole) >= 25 > sum(r["n"] for r in whole) - max(r["n"] for r in whole)
    turns = samples.diverse(df, "label", "id", "alt", 7).orderBy("turn").collect()
    assert sorted((r.turn, r.label) for r in turns) == [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "c"), (3, "a")]


def test_histories_over_many_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "a" if i < 300 else f"s{i % 7}", int(rng.integers(0, 50))) for i in range(400)] + [(900, None, 1)]
    df = spark.createDataFrame(rows, "obs_id long, station string, start int")
    got = {(r.query_id, r.rank): r.id for r in precedent.same_station(df, 4).collect()}
    want = {}
    for station in {s for _, s, _ in rows if s}:
        order = sorted((t, i) for i, s, t in rows if s == station)
        for j, (_, i) in enumerate(order):
            want |= {(i, rank): order[j - rank][1] for rank in range(1, 5) if j >= rank}
    assert got == want


@pytest.mark.parametrize("metric, cold", [("cosine", False), ("euclidean", True)])
def test_neighbours_in_blocks(spark, metric, cold):
    rng = np.random.default_rng(6)
    vec = rng.integers(-2, 3, (300, 4)).astype(float)
    vec[0] = 0
    df = spark.createDataFrame([(i, [None, "a", "b"][i % 3], [float(x) for x in v]) for i, v in enumerate(vec)], "id long, entity string, vec array<double>").repartition(5)
    got = {}
    for r in precedent.nearest(df, df.where("id % 10 = 0"), 5, metric, cold, block=8).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    for q in range(0, 300, 10):
        if metric == "cosine":
            n = np.linalg.norm(vec, axis=1) * np.linalg.norm(vec[q])
            near = np.where(n > 0, vec @ vec[q] / np.where(n > 0, n, 1), 0)
        else:
            near = -np.sqrt(((vec - vec[q]) ** 2).sum(1))
        allowed = [i for i in range(300) if i != q and not (cold and q % 3 and i % 3 == q % 3)]
        want = sorted(-np.round(near[i], 9) for i in allowed)[:5]
        mine = [i for _, i in sorted(got[q])]
        assert all(i in allowed for i in mine) and [-np.round(near[i], 9) for i in mine] == pytest.approx(want)


def test_late_events_end_sessions_of_a_stream(spark, tmp_path):
    """A stream gives a session once the watermark has passed it, as the table's rule has it."""
    from reviewlane.streaming.sessions import sessions

    rows = [(1, "2026-01-01 00:00:00"), (1, "2026-01-01 01:00:00"), (2, "2026-01-01 00:30:00"), (1, "2026-01-02 00:00:00"), (3, "2026-01-05 00:00:00")]
    df = spark.createDataFrame(rows, "user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    whole = {(r.user_id, r.n, r.first) for r in sessions(df).collect()}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    done = sessions(stream, late="1 hour").writeStream.format("memory").queryName("ended").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    done.awaitTermination()
    ended = {(r.user_id, r.n, r.first) for r in spark.sql("SELECT * FROM ended").collect()}
    assert ended == {x for x in whole if x[0] != 3}


def test_weights_made_at_once(spark):
    """Groups of all lengths, also beyond one block of MD5, have the weights of single digests."""
    groups = ["", "a", "ü b", "x" * 46, "x" * 47, "x" * 48, "x" * 200, *(f"{i}:24:1998" for i in range(30))]
    for draws, seed in ((1, 7), (4000, 42), (437, 123456789)):
        made = inference.weights_of(groups, draws, seed)
        assert (made == np.stack([inference.draw_weights(g, draws, seed) for g in groups])).all()
    assert inference.weights_of([], 5, 1).shape == (0, 5)


def test_resampled_sums_are_exact_by_value(spark):
    """A group's weights are made once for all its values; sums are whole numbers of any size and sign."""
    rng = np.random.default_rng(5)
    rows = [(f"g{rng.integers(0, 9000)}", int(rng.integers(0, 3)) or None, int(rng.integers(-(1 << 46), 1 << 46))) for _ in range(20_000)]
    frame = spark.createDataFrame(rows, "grp string, bin int, v long")
    found = {(r.draw, r.bin): r.v for r in inference.resampled(frame.coalesce(1), "grp", {"v": F.col("v")}, 6, 9, ["bin"]).collect()}
    weights = {g: inference.draw_weights(g, 6, 9) for g, *_ in rows}
    assert found == {(d, b): sum(int(weights[g][d]) * v for g, x, v in rows if x == b) for d in range(6) for b in (None, 1, 2)}


def test_areas_of_few_and_many_values_agree(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(float(rng.integers(0, 40)) / 40, float(rng.integers(0, 5)), int(rng.random() < 0.4), f"g{rng.integers(0, 70)}") for _ in range(400)]
    frame = spark.createDataFrame(rows, "p double, r double, y int, grp string")
    areas = lambda: {(r.of, r.draw): r.value for r in inference.auc_in_draws(frame, ["p", "r"], "y", "grp", 9, 3).collect()}
    few = areas()
    monkeypatch.setattr(inference, "FEW_VALUES", 20)
    assert areas() == few and len(few) == 20
    p, r, y = ([x[i] for x in rows] for i in range(3))
    for d in range(9):
        w = [int(inference.draw_weights(x[3], 9, 3)[d]) for x in rows]
        assert few[0, d] == pytest.approx(rank_area(p, y, w), abs=1e-12) and few[1, d] == pytest.approx(rank_area(r, y, w), abs=1e-12)


def test_orderings_take_only_their_heads(spark, sf, tmp_path, monkeypatch):
    """A queue and the orderings beside it are not written down for each ordering; before, all rows were, three times each."""
    for name, keys in (("orders", {"o_orderkey": 10_000, "o_custkey": 1000}), ("lineitem", {"l_orderkey": 10_000}), ("customer", {"c_custkey": 1000})):
        copies = spark.read.parquet(f"{sf}/{name}.parquet").crossJoin(spark.range(16).select(F.col("id").alias("copy")))
        copies.withColumns({k: F.col(k) + F.col("copy") * step for k, step in keys.items()}).drop("copy").write.parquet(str(tmp_path / f"{name}.parquet"))
    n, shared = spark.read.parquet(str(tmp_path / "orders.parquet")).count(), Path(shared_folder(spark).removeprefix("file:"))
    monkeypatch.setattr(queries, "DRAWS", 40)
    for query in (queries.queue_differences, queries.queue_lift_interval):
        held = sum(f.stat().st_size for f in shared.rglob("*") if f.is_file())
        query(spark, str(tmp_path)).collect()
        assert sum(f.stat().st_size for f in shared.rglob("*") if f.is_file()) - held < 150 * n


def test_first_rows_with_and_without_positions(spark, monkeypatch):
    """Heads of an order are the same however they are found, also where few groups hold most rows and the head must be doubled."""
    rng = np.random.default_rng(8)
    rows = [(i, float(rng.integers(0, 9)) or None, "hot" if rng.random() < 0.9 else f"g{i % 40}", bool(rng.random() < 0.3)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, v double, grp string, conflict boolean").repartition(5)
    budgets = inference.draw_budgets(frame, "grp", 10, 20, 4).localCheckpoint()
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    weights = {g: inference.draw_weights(g, 20, 4) for g in {r[2] for r in rows}}
    want = {b.draw: sum([c for _, _, g, c in order for _ in range(weights[g][b.draw])][: b.budget]) for b in budgets.collect()}
    for most in (100_000, 7):
        monkeypatch.setattr(ranking, "MOST_FIRST", most)
        assert [r.id for r in ranking.first_rows(frame, ["v", "id"], 50).orderBy("v", "id").collect()] == [r[0] for r in order[:50]]
        assert {r.draw: r.found for r in inference.found_in_draws(frame, ["v", "id"], budgets, "grp", 20, 4).collect()} == want
