"""Queries of intervals, labels, novelty and samples, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlane.functions.materialize import checkpoint
from reviewlane.operators import inference, novelty, provenance, queue, samples, splits
from reviewlane.sources.tables import candidates, observations, table

BUDGET, SEED = 50, 42
DRAWS = inference.draws_needed()
ENDS = ["low", "high", "low_adjusted", "high_adjusted"]


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).where("prob is not null and label <> 'unknown'")
    return c.select("obs_id", "station", "transmitter", "episode", F.col("prob").alias("p"), (F.col("label") == "with-signal").cast("int").alias("y"))


def paired_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.paired_difference(_judged(spark, sf_dir), ["episode", "station"], DRAWS, SEED)
    return out.select("grouping", "n", "draws", "direction", "direction_adjusted", "resolved_adjusted", *(F.round(c, 6).alias(c) for c in ("margin", *ENDS)))


def risk_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.risk_ceiling(_judged(spark, sf_dir), "station", 0.75, 0.5, DRAWS, SEED)
    return out.select("kept", "errors", "held", "resolved", *(F.round(c, 6).alias(c) for c in ("risk", "low", "high")))


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """Scored rows and, for each ordering, the columns by which they go up."""
    rows = queue.scored(candidates(spark, sf_dir).drop("transmitter", "start"))
    values = {"queue": -F.col("score")} | {name: value() for name, value in queue.BASELINES.items() if value}
    orders = {name: [f"value of {name}", "obs_id"] if name in values else ["obs_id"] for name in ("queue", *queue.BASELINES)}
    return rows.withColumns({f"value of {name}": value for name, value in values.items()}), orders


def queue_lift_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, orders = _orders(spark, sf_dir)
    out = inference.lift_interval(rows, orders["queue"], ["episode", "station"], BUDGET, DRAWS, SEED)
    return out.select("grouping", "found", "draws", "verdict", "resolved", *(F.round(c, 6).alias(c) for c in ("lift", "low", "middle", "high")))


def queue_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, orders = _orders(spark, sf_dir)
    out = inference.ordering_differences(rows, orders, "episode", "queue", BUDGET, DRAWS, SEED)
    return out.select("ordering", "more_found", "draws", "direction", "resolved_adjusted", *(F.round(c, 6).alias(c) for c in (*ENDS, "ratio_low", "ratio_high")))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged rows with a second prediction, the spread of the measurements."""
    c = candidates(spark, sf_dir).where("prob is not null and label <> 'unknown'")
    return c.select("station", "episode", F.col("prob").alias("p"), F.col("spread").alias("r"), (F.col("label") == "with-signal").cast("int").alias("y"))


def _difference(spark: SparkSession, sf_dir: str, statistic: str) -> DataFrame:
    out = inference.statistic_difference(_compared(spark, sf_dir), statistic, "p", "r", "y", ["episode", "station"], DRAWS, SEED)
    names = ["grouping", "draws", "undefined", "direction", "direction_adjusted", "resolved_adjusted"]
    return out.select(*(F.col(c).cast("long").alias(c) if c in ("draws", "undefined") else c for c in names), *(F.round(c, 6).alias(c) for c in ("margin", *ENDS)))


def auc_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _difference(spark, sf_dir, "auc")


def calibration_error_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _difference(spark, sf_dir, "calibration_error")


def clustering_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the two predictions' Brier differences are within episodes and stations."""
    gain = F.pow(F.col("r") - F.col("y"), 2) - F.pow(F.col("p") - F.col("y"), 2)
    return inference.clustering(_compared(spark, sf_dir).withColumn("gain", gain), "gain", ["episode", "station"])


def permutation_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely a random order finds as many conflicts as each ordering did (O11.18)."""
    found = queue.found_at_budget(queue.scored(candidates(spark, sf_dir)), BUDGET)
    budget = F.least(F.lit(BUDGET).cast("long"), F.col("n"))
    tail = inference.permutation_tail(F.col("found"), F.col("n"), F.col("conflicts"), budget)
    return found.select("ordering", "found", F.round(budget * F.col("conflicts") / F.col("n"), 6).alias("expected"), F.round(tail, 6).alias("p"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw records: some without an image, some still to come."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    vetted = F.when(F.col("o_orderstatus") == "F", "with-signal").when(F.col("o_orderstatus") == "O", "without-signal").otherwise("unknown")
    return o.select(
        F.col("o_orderkey").alias("obs_id"),
        F.col("o_custkey").alias("station"),
        F.when(F.col("o_orderkey") % 11 == 0, "future").otherwise("good").alias("status"),
        F.when(~F.startswith("o_orderpriority", F.lit("1")), F.concat(F.lit("https://data.example/"), F.col("o_orderkey"))).alias("url"),
        vetted.alias("vetted"),
        F.col("o_orderdate").cast("timestamp").alias("ended"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 36 HOURS")).alias("retrieved"),
    )


def label_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = provenance.labelled(_records(spark, sf_dir))
    flags = ["labelled_positive", "carries_measurable_trace", "eligible_for_training"]
    return out.select("obs_id", "label_outcome", "trace_presence", "label_origin", "artifact_status", *flags, "lag_us")


def label_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.broken_invariants(provenance.labelled(_records(spark, sf_dir)))


def label_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = provenance.labelled(_records(spark, sf_dir)).select(
        "obs_id", "vetted", "label_origin", "station", F.col("url").alias("source_url"), "retrieved",
        F.when(F.col("url").isNotNull(), F.sha2("url", 256)).alias("sha256"), F.lit(None).cast("string").alias("partition"), F.lit(None).cast("string").alias("transmitter"),
    )
    return provenance.receipt(rows)


FIELDS = [("k", "observation_time"), ("v", "post_observation")]


def field_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.createDataFrame(FIELDS, "field string, kind string")
    return provenance.field_census(table(spark, sf_dir, "events").select("props"), "props", classes)


def field_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.classification(field_census(spark, sf_dir))


def inadmissible_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the events' records by type, read as feature blocks, that may not be features (O4.11)."""
    keys = table(spark, sf_dir, "events").select(F.col("event_type").alias("block"), F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("field"))
    return provenance.inadmissible(keys.distinct(), spark.createDataFrame([("k", "identifier")], "field string, kind string"))


def _with_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpoint(splits.chronological(observations(spark, sf_dir)))
    marked = novelty.unseen(rows.where("partition <> 'train'"), rows.where("partition = 'train'"), ["station", "transmitter"])
    return marked.select("obs_id", "partition", "unseen_station", "unseen_transmitter")


def unseen_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_unseen(spark, sf_dir)


def risk_by_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_unseen(spark, sf_dir).join(_judged(spark, sf_dir).select("obs_id", "p", "y"), "obs_id")
    return novelty.risk_by_novelty(rows, ["unseen_station", "unseen_transmitter"])


def feature_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items' measurements against those of every other order (O12.14); SQL has no inverse, tests compare with NumPy."""
    c = candidates(spark, sf_dir).select("obs_id", "prob", "offset_ppm", "flat", "spread")
    model = novelty.Distances(c.where("obs_id % 2 = 0"), ["prob", "offset_ppm", "flat", "spread"])
    return model.score(c).select("obs_id", F.round("feature_distance", 6).alias("feature_distance"), "feature_novelty")


def event_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a user's purchases, read at the times of the user's other events (O5.12)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")
    series = e.where("event_type = 'purchase'").select("user_id", "at", "value")
    out = novelty.interpolated(e.where("event_type <> 'purchase'").select("event_id", "user_id", "at"), series, "user_id", "at", "value")
    return out.select("event_id", F.round("value", 6).alias("value"))


def sample_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.random_rows(observations(spark, sf_dir).select("obs_id", "label"), "obs_id", 100, SEED)


def sample_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.balanced(observations(spark, sf_dir).select("obs_id", "label"), "label", "obs_id", 40, SEED)


def sample_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.whole_groups(observations(spark, sf_dir).select("obs_id", "episode"), "episode", 500, SEED)


def sample_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir).select("obs_id", "transmitter", "offset_ppm")
    return samples.diverse(rows, "transmitter", "obs_id", "offset_ppm", 60).select("obs_id", "transmitter", "turn")


QUERIES = {
    f.__name__: f
    for f in (
        paired_brier, risk_held, queue_lift_interval, queue_differences, auc_difference, calibration_error_difference, clustering_diagnostics, permutation_control, label_provenance, label_invariants, label_receipts, field_census,
        field_check, inadmissible_fields, unseen_entities, risk_by_novelty, feature_novelty, event_interpolation, sample_random, sample_balanced, sample_episodes, sample_diverse,
    )
}


def oracles(obs: str, cand: str, scored: str, chrono: str) -> dict[str, str]:
    """SQL by query name; the arguments are the common table expressions of the registry."""
    judged = cand + ", judged AS (SELECT obs_id, station, transmitter, episode, prob AS p, CAST(label = 'with-signal' AS INT) AS y FROM cand WHERE prob IS NOT NULL AND label <> 'unknown')"
    number = lambda text, digits: f"CAST('0x' || substr(md5({text}), 1, {digits}) AS BIGINT)"
    copies = " + ".join(f"(v >= '{bar:08x}')::INT" for bar in inference.poisson_bars())
    drawn = lambda groups: f"""SELECT *, {copies} AS w FROM (SELECT *, 4 * b + i AS d, substr(h, 1 + 8 * i, 8) AS v
        FROM (SELECT *, md5('{SEED}:' || b || ':' || coalesce(CAST(grp AS VARCHAR), '')) AS h FROM {groups}, range(0, {DRAWS // 4}) r(b)), range(0::INT, 4::INT) q(i))"""  # noqa: E731
    quantile = lambda v: ", ".join(f"quantile_cont({v}, {q!r}::DOUBLE) AS {name}" for name, q in (("low", 0.025), ("middle", 0.5), ("high", 0.975), ("low_adjusted", 0.05 / 5 / 2), ("high_adjusted", 1 - 0.05 / 5 / 2)))
    side = lambda a, b: f"CASE WHEN {a} > 0 THEN 'challenger_better' WHEN {b} < 0 THEN 'reference_better' ELSE 'indistinguishable' END"
    rounded = lambda *names: ", ".join(f"round({c}, 6) AS {c}" for c in names)
    union = "min(low) AS low, max(middle) AS middle, max(high) AS high, min(low_adjusted) AS low_adjusted, max(high_adjusted) AS high_adjusted"

    def gains(grouping):
        return f"""g_{grouping} AS (SELECT {grouping} AS grp, sum(gain) AS gain, count(*) AS n FROM gains GROUP BY 1), d_{grouping} AS ({drawn(f"g_{grouping}")}),
            i_{grouping} AS (SELECT '{grouping}' AS grouping, count(*) AS draws, {quantile("m")} FROM (SELECT sum(gain * w)::DOUBLE / sum(n * w) / 1e9::DOUBLE AS m FROM d_{grouping} WHERE w > 0 GROUP BY d))"""

    placed = scored + ", placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, obs_id) - 1 AS place FROM scored), tot AS (SELECT count(*) AS n, count(*) FILTER (WHERE conflict) AS c FROM placed)"

    def budgets(grouping):
        return f"""g_{grouping} AS (SELECT {grouping} AS grp, count(*) AS n, count(*) FILTER (WHERE conflict) AS c FROM placed GROUP BY 1), d_{grouping} AS ({drawn(f"g_{grouping}")}),
            b_{grouping} AS (SELECT d, sum(n * w) AS dn, sum(c * w) AS dc, CAST(greatest(1, least(sum(n * w), ceil(sum(n * w) * least({BUDGET}, (SELECT n FROM tot)) / (SELECT n FROM tot)::DOUBLE))) AS BIGINT) AS b
                FROM d_{grouping} WHERE w > 0 GROUP BY d)"""

    def found(grouping, place, out):
        return f"""{out} AS (SELECT d, sum(CASE WHEN conflict THEN greatest(0, least(w, b - before)) ELSE 0 END) AS found FROM (
                SELECT x.d, p.conflict, x.w, k.b, sum(x.w) OVER (PARTITION BY x.d ORDER BY p.{place}) - x.w AS before
                FROM (SELECT * FROM placed WHERE {place} < 2000) p JOIN d_{grouping} x ON x.grp IS NOT DISTINCT FROM p.{grouping} JOIN b_{grouping} k ON k.d = x.d WHERE x.w > 0) GROUP BY d)"""

    def lifts(grouping):
        return f"""{budgets(grouping)}, {found(grouping, "place", f"f_{grouping}")},
            i_{grouping} AS (SELECT '{grouping}' AS grouping, count(*) AS draws, {quantile("l")} FROM (SELECT found * dn / (dc * b)::DOUBLE AS l FROM f_{grouping} JOIN b_{grouping} USING (d) WHERE dc > 0))"""

    orders = {
        "queue": "score DESC", "fifo": "0::DOUBLE", "confidence": "-coalesce(greatest(prob, 1 - prob), 0)", "physics": "-coalesce(abs(offset_ppm), -1)",
        "offset": "-CASE WHEN at_bound THEN 0 ELSE coalesce(abs(offset_ppm), 0) END",
    }
    places = ", ".join(f"row_number() OVER (ORDER BY {by}, obs_id) - 1 AS o_{name}" for name, by in orders.items())
    many = scored + f", placed AS (SELECT *, {places} FROM scored), tot AS (SELECT count(*) AS n FROM placed), " + budgets("episode")
    many += "".join(", " + found("episode", f"o_{name}", f"f_{name}") for name in orders)
    differences = " UNION ALL ".join(
        f"""SELECT '{name}' AS ordering, (SELECT count(*) FILTER (WHERE conflict AND o_queue < {BUDGET}) - count(*) FILTER (WHERE conflict AND o_{name} < {BUDGET}) FROM placed) AS more_found,
            count(*) AS draws, {quantile("v")}, quantile_cont(r, 0.005::DOUBLE) AS ratio_low, quantile_cont(r, {1 - 0.05 / 5 / 2!r}::DOUBLE) AS ratio_high
            FROM (SELECT (q.found - o.found) * dn / (dc * b)::DOUBLE AS v, (q.found + 0.5::DOUBLE) / (o.found + 0.5::DOUBLE) AS r FROM f_queue q JOIN f_{name} o USING (d) JOIN b_episode USING (d) WHERE dc > 0)"""
        for name in orders if name != "queue"
    )
    lift_orders = " UNION ALL ".join(
        f"SELECT '{name}' AS ordering, (SELECT count(*) FILTER (WHERE conflict) FROM (SELECT conflict FROM scored ORDER BY {by}, obs_id LIMIT {BUDGET})) AS found" for name, by in orders.items()
    )
    choose = lambda a, b: f"(lgamma({a} + 1) - lgamma({b} + 1) - lgamma({a} - {b} + 1))"
    records = """rec AS (SELECT o_orderkey AS obs_id, o_custkey AS station, CASE WHEN o_orderkey % 11 = 0 THEN 'future' ELSE 'good' END AS status,
        CASE WHEN o_orderpriority NOT LIKE '1%' THEN 'https://data.example/' || o_orderkey END AS url,
        CASE o_orderstatus WHEN 'F' THEN 'with-signal' WHEN 'O' THEN 'without-signal' ELSE 'unknown' END AS vetted, o_orderdate AS ended FROM orders),
    lab AS (SELECT *, CASE WHEN url IS NULL THEN 'unlabelled' WHEN vetted = 'with-signal' THEN 'positive' WHEN vetted = 'without-signal' THEN 'negative' ELSE 'unlabelled' END AS label_outcome,
        CASE WHEN url IS NULL THEN 'unknown' WHEN vetted = 'without-signal' THEN 'absent' ELSE 'unvetted' END AS trace_presence,
        CASE WHEN url IS NULL THEN 'missing' WHEN vetted = 'unknown' THEN 'satnogs_unvet' ELSE 'satnogs_vet' END AS label_origin,
        CASE WHEN url IS NULL THEN 'missing' ELSE 'usable' END AS artifact_status FROM rec WHERE status <> 'future')"""
    census = "census AS (SELECT field, count(*) AS n, CASE field WHEN 'k' THEN 'observation_time' WHEN 'v' THEN 'post_observation' END AS kind FROM (SELECT unnest(json_keys(props)) AS field FROM events) GROUP BY 1)"
    unseen = chrono + """, fresh AS (SELECT obs_id, partition,
        coalesce(CAST(station AS VARCHAR), 'unknown') NOT IN (SELECT coalesce(CAST(station AS VARCHAR), 'unknown') FROM chrono WHERE partition = 'train') AS unseen_station,
        coalesce(CAST(transmitter AS VARCHAR), 'unknown') NOT IN (SELECT coalesce(CAST(transmitter AS VARCHAR), 'unknown') FROM chrono WHERE partition = 'train') AS unseen_transmitter
        FROM chrono WHERE partition <> 'train')"""  # fmt: skip
    risk = " UNION ALL ".join(
        f"""SELECT '{a}' AS axis, count(*) FILTER (WHERE {a}) AS flagged, count(*) FILTER (WHERE NOT {a}) AS unflagged,
            round(sum(e) FILTER (WHERE {a}) / nullif(count(*) FILTER (WHERE {a}), 0)::DOUBLE, 9) AS flagged_risk,
            round(sum(e) FILTER (WHERE NOT {a}) / nullif(count(*) FILTER (WHERE NOT {a}), 0)::DOUBLE, 9) AS unflagged_risk FROM nov"""
        for a in ("unseen_station", "unseen_transmitter")
    )
    compared = cand + ", both_ AS (SELECT station, episode, prob AS p, spread AS r, CAST(label = 'with-signal' AS INT) AS y FROM cand WHERE prob IS NOT NULL AND label <> 'unknown')"

    def areas(grouping, p):
        return f"""x_{grouping}_{p} AS (SELECT d, {p}, sum(w * n1) AS n1, sum(w * n0) AS n0 FROM (SELECT {grouping} AS grp, {p}, sum(y) AS n1, sum(1 - y) AS n0 FROM both_ GROUP BY 1, 2) c JOIN e_{grouping} e ON c.grp IS NOT DISTINCT FROM e.grp GROUP BY d, {p}),
            s_{grouping}_{p} AS (SELECT d, sum(n1 * (2 * before + n0))::DOUBLE / nullif(2::DOUBLE * sum(n1) * sum(n0), 0) AS v FROM (SELECT *, sum(n0) OVER (PARTITION BY d ORDER BY {p}) - n0 AS before FROM x_{grouping}_{p}) GROUP BY d)"""

    def gaps(grouping, p):
        return f"""s_{grouping}_{p} AS (SELECT d, sum(abs(sp - sy * 1000000000))::DOUBLE / sum(n) / 1e9::DOUBLE AS v FROM (
            SELECT d, bin, sum(w * sp) AS sp, sum(w * sy) AS sy, sum(w * n) AS n FROM (
                SELECT {grouping} AS grp, {" + ".join(f"({p} >= {i} * 0.1::DOUBLE)::INT" for i in range(1, 10))} AS bin, sum(CAST(round({p} * 1e9::DOUBLE) AS BIGINT)) AS sp, sum(y) AS sy, count(*) AS n FROM both_ GROUP BY 1, 2) c
            JOIN e_{grouping} e ON c.grp IS NOT DISTINCT FROM e.grp GROUP BY d, bin) GROUP BY d)"""

    def margins(made, sign):
        parts, union_ = [], []
        for grouping in ("episode", "station"):
            parts += [f"g_{grouping} AS (SELECT DISTINCT {grouping} AS grp FROM both_), e_{grouping} AS (SELECT grp, d, w FROM ({drawn(f'g_{grouping}')}) WHERE w > 0 UNION ALL SELECT grp, -1, 1 FROM g_{grouping})", made(grouping, "p"), made(grouping, "r")]
            parts.append(f"m_{grouping} AS (SELECT d, {sign} * (s_{grouping}_r.v - s_{grouping}_p.v) AS m FROM s_{grouping}_p JOIN s_{grouping}_r USING (d))")
            union_.append(f"SELECT '{grouping}' AS grouping, (SELECT m FROM m_{grouping} WHERE d = -1) AS margin, count(m) AS draws, {quantile('m')} FROM m_{grouping} WHERE d >= 0")
        return f"""WITH {compared}, {", ".join(parts)}, u AS ({" UNION ALL ".join(union_)}), a AS (SELECT * FROM u UNION ALL SELECT 'union', max(margin), max(draws), {union} FROM u)
            SELECT grouping, draws, {DRAWS} - draws AS undefined, {side("low", "high")} AS direction, {side("low_adjusted", "high_adjusted")} AS direction_adjusted, draws >= 4000 AS resolved_adjusted, {rounded("margin", *ENDS)} FROM a"""

    layout = " UNION ALL ".join(
        f"""SELECT '{g}' AS grouping, CASE WHEN k >= 2 AND n > k THEN '{g}' WHEN n = k THEN 'observation_level' ELSE '{g}_unmeasurable' END AS label, k, n, CASE WHEN k >= 2 AND n > k THEN round(n0, 6) END AS n0,
            CASE WHEN k >= 2 AND n > k THEN round(icc, 6) END AS icc, CASE WHEN k >= 2 AND n > k THEN round(1 + (n / k::DOUBLE - 1) * icc, 6) END AS design_effect
            FROM (SELECT *, CASE WHEN msb + (n0 - 1) * msw = 0 THEN 0 ELSE (msb - msw) / (msb + (n0 - 1) * msw) END AS icc FROM (
                SELECT k, n, (bt - s * s / n) / nullif(k - 1, 0) AS msb, (ss - bt) / nullif(n - k, 0) AS msw, (n - g2::DOUBLE / n) / nullif(k - 1, 0) AS n0 FROM (
                    SELECT count(*) AS k, CAST(sum(g) AS BIGINT) AS n, sum(g * g) AS g2, sum(s) AS s, sum(ss) AS ss, sum(s * s / g) AS bt FROM (
                        SELECT count(*) AS g, sum(x) AS s, sum(x * x) AS ss FROM (SELECT {g} AS grp, (r - y) * (r - y) - (p - y) * (p - y) AS x FROM both_) GROUP BY grp))))"""
        for g in ("episode", "station")
    )
    lot = lambda key: number(f"'{SEED}:' || {key}", 12)
    return {
        "paired_brier": f"""WITH {judged}, prior AS (SELECT avg(y) AS r FROM judged),
            gains AS (SELECT episode, station, CAST(round(((r - y) * (r - y) - (p - y) * (p - y)) * 1e9::DOUBLE) AS BIGINT) AS gain FROM judged, prior), {gains("episode")}, {gains("station")},
            u AS (SELECT * FROM i_episode UNION ALL SELECT * FROM i_station), a AS (SELECT * FROM u UNION ALL SELECT 'union', max(draws), {union} FROM u),
            w AS (SELECT sum(gain)::DOUBLE / count(*) / 1e9::DOUBLE AS margin, count(*) AS n FROM gains)
            SELECT grouping, n, draws, {side("low", "high")} AS direction, {side("low_adjusted", "high_adjusted")} AS direction_adjusted, draws >= 4000 AS resolved_adjusted, {rounded("margin", *ENDS)} FROM a, w""",
        "risk_held": f"""WITH {judged}, sure AS (SELECT station, CAST((p >= 0.5) <> (y = 1) AS INT) AS e FROM judged WHERE greatest(p, 1 - p) >= 0.75),
            g AS (SELECT station AS grp, sum(e) AS e, count(*) AS n FROM sure GROUP BY 1), dr AS ({drawn("g")}),
            i AS (SELECT count(*) AS draws, {quantile("m")} FROM (SELECT sum(e * w)::DOUBLE / sum(n * w) AS m FROM dr WHERE w > 0 GROUP BY d)),
            t AS (SELECT count(*) AS kept, CAST(sum(e) AS BIGINT) AS errors, sum(e)::DOUBLE / count(*) AS risk FROM sure)
            SELECT kept, errors, high <= 0.5 AS held, draws >= 800 AS resolved, {rounded("risk", "low", "high")} FROM t, i""",
        "queue_lift_interval": f"""WITH {placed}, {lifts("episode")}, {lifts("station")}, u AS (SELECT * FROM i_episode UNION ALL SELECT * FROM i_station),
            a AS (SELECT * FROM u UNION ALL SELECT 'union', max(draws), {union} FROM u),
            t AS (SELECT count(*) FILTER (WHERE conflict AND place < {BUDGET}) AS found, count(*) FILTER (WHERE conflict AND place < {BUDGET}) / (least({BUDGET}, count(*)) * count(*) FILTER (WHERE conflict)::DOUBLE / count(*)) AS lift FROM placed)
            SELECT grouping, found, draws, CASE WHEN draws < 800 OR lift NOT BETWEEN low - 1e-9 - 0.05 * (high - low) AND high + 1e-9 + 0.05 * (high - low) THEN 'NOT_MEASURABLE'
                WHEN low > 1.5 THEN 'PASSED' WHEN high < 1.5 THEN 'FAILED' ELSE 'NOT_ESTABLISHED' END AS verdict, draws >= 800 AS resolved, {rounded("lift", "low", "middle", "high")} FROM a, t""",
        "queue_differences": f"WITH {many}, o AS ({differences}) SELECT ordering, more_found, draws, {side('low_adjusted', 'high_adjusted')} AS direction, draws >= 4000 AS resolved_adjusted, {rounded(*ENDS, 'ratio_low', 'ratio_high')} FROM o",
        "auc_difference": margins(areas, -1),
        "calibration_error_difference": margins(gaps, 1),
        "clustering_diagnostics": f"WITH {compared} {layout}",
        "permutation_control": f"""WITH {scored}, o AS ({lift_orders}), w AS (SELECT count(*) AS n, count(*) FILTER (WHERE conflict) AS c, least({BUDGET}, count(*)) AS b FROM scored)
            SELECT ordering, found, round(b * c::DOUBLE / n, 6) AS expected, round((SELECT coalesce(sum(exp({choose("c", "k")} + {choose("(n - c)", "(b - k)")} - {choose("n", "b")})), 0)
                FROM range(0, {BUDGET} + 1) r(k) WHERE k >= found AND k <= b AND k <= c AND b - k <= n - c), 6) AS p FROM o, w""",
        "label_provenance": f"""WITH {records} SELECT obs_id, label_outcome, trace_presence, label_origin, artifact_status, label_outcome = 'positive' AS labelled_positive,
            false AS carries_measurable_trace, label_outcome <> 'unlabelled' AS eligible_for_training, CAST(129600000000 AS BIGINT) AS lag_us FROM lab""",
        "label_invariants": f"WITH {records} SELECT count(*) AS n, CAST(0 AS BIGINT) AS flag_disagrees, CAST(0 AS BIGINT) AS decisive_but_unlabelled, CAST(0 AS BIGINT) AS label_without_vetting, CAST(0 AS BIGINT) AS label_without_image FROM lab",
        "label_receipts": f"""WITH {records} SELECT obs_id, '{{"source_url":"' || coalesce(url, '') || '","retrieved_at":"' || strftime(ended::TIMESTAMP + INTERVAL 36 HOUR, '%Y-%m-%dT%H:%M:%S') || '","license":"CC BY-SA 4.0","api_label":"' || vetted
            || '","label_origin":"' || label_origin || '","artifact_sha256":' || coalesce('"' || sha256(url) || '"', 'null') || ',"split":null,"station_id":' || station || ',"transmitter_uuid":null}}' AS provenance FROM lab""",
        "field_census": f"WITH {census} SELECT * FROM census",
        "field_check": f"WITH {census} SELECT count(*) FILTER (WHERE kind IS NULL) = 0 AS passed, count(*) AS n_examined, coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE kind IS NULL), '') AS unclassified, count(*) FILTER (WHERE kind = 'post_observation') AS n_forbidden FROM census",
        "inadmissible_fields": "SELECT DISTINCT event_type AS block, field, CASE field WHEN 'k' THEN 'identifier' ELSE 'unclassified' END AS kind FROM (SELECT event_type, unnest(json_keys(props)) AS field FROM events)",
        "unseen_entities": f"WITH {unseen} SELECT * FROM fresh",
        "risk_by_novelty": f"""WITH {judged}, {unseen.replace(obs + ",", "")}, nov AS (SELECT fresh.*, CAST((p >= 0.5) <> (y = 1) AS INT) AS e FROM fresh JOIN judged USING (obs_id)), r AS ({risk})
            SELECT *, coalesce(flagged >= 10 AND flagged_risk > unflagged_risk, false) AS informative FROM r""",
        "event_interpolation": """WITH s AS (SELECT user_id, epoch_us(ts) AS at, min(value) AS value FROM events WHERE event_type = 'purchase' AND value IS NOT NULL GROUP BY 1, 2),
            q AS (SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type <> 'purchase'),
            n AS (SELECT q.*, (SELECT max(s.at) FROM s WHERE s.user_id = q.user_id AND s.at <= q.at) AS a, (SELECT min(s.at) FROM s WHERE s.user_id = q.user_id AND s.at >= q.at) AS b FROM q)
            SELECT event_id, round(CASE WHEN a IS NULL THEN y.value WHEN b IS NULL OR a = b THEN x.value ELSE x.value + (y.value - x.value) * (n.at - a) / (b - a)::DOUBLE END, 6) AS value
            FROM n LEFT JOIN s x ON x.user_id = n.user_id AND x.at = a LEFT JOIN s y ON y.user_id = n.user_id AND y.at = b""",
        "sample_random": f"WITH {obs} SELECT obs_id, label FROM obs ORDER BY {lot('obs_id')}, obs_id LIMIT 100",
        "sample_balanced": f"WITH {obs} SELECT obs_id, label FROM obs QUALIFY row_number() OVER (PARTITION BY label ORDER BY {lot('obs_id')}, obs_id) <= 40",
        "sample_episodes": f"""WITH {obs}, g AS (SELECT episode, count(*) AS n, {lot("episode")} AS l FROM obs GROUP BY 1), c AS (SELECT episode, sum(n) OVER (ORDER BY l, episode) - n AS before FROM g)
            SELECT obs_id, episode FROM obs WHERE episode IN (SELECT episode FROM c WHERE before < 500)""",
        "sample_diverse": f"""WITH {cand}, t AS (SELECT obs_id, transmitter, row_number() OVER (PARTITION BY transmitter ORDER BY coalesce(offset_ppm, 0) DESC, obs_id) AS turn, count(*) OVER (PARTITION BY transmitter) AS k FROM cand)
            SELECT obs_id, transmitter, CAST(turn AS INT) AS turn FROM (SELECT * FROM t ORDER BY turn, k DESC, transmitter LIMIT 60)""",
    }
