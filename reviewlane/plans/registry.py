"""Queries by name and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlane.functions import records
from reviewlane.functions.materialize import checkpoint
from reviewlane.functions.ranking import average_rank, percentiles
from reviewlane.operators import metrics, precedent, queue, splits
from reviewlane.plans import grounding, inference, models, rates, sources
from reviewlane.sources.tables import candidates, observations, table
from reviewlane.streaming import sessions

BUDGET = 50


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = queue.scored(candidates(spark, sf_dir))
    best = queue.top(queue.best_of_episode(rows, ["station", "transmitter", "label", "reasons", "conflict"]), BUDGET)
    return best.select("rank", "obs_id", "episode", "station", "label", "score", F.array_join("reasons", ",").alias("reasons"), "conflict")


def queue_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = queue.scored(candidates(spark, sf_dir))
    return queue.ranked(queue.best_of_episode(rows, ["conflict"])).select("obs_id", "score", "conflict", F.col("rank").cast("long").alias("rank"))


def queue_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = queue.scored(candidates(spark, sf_dir))
    ranked = queue.ranked(queue.best_of_episode(rows, ["station", "transmitter"])).drop("episode")
    return queue.apply_caps(ranked, BUDGET).select("obs_id", "rank", "station", "transmitter", "admitted", "by_station", "by_transmitter")


def queue_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = queue.scored(candidates(spark, sf_dir))
    return queue.found_at_budget(rows, BUDGET)


def reason_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    codes = queue.reasons(*(F.col(x) for x in ("label", "prob", "offset_ppm", "at_bound", "flat")))
    return c.select(F.explode(codes).alias("reason"), "label").groupBy("reason", "label").agg(F.count("*").alias("n"))


def criteria_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn(
        "reasons", queue.reasons(*(F.col(x) for x in ("label", "prob", "offset_ppm", "at_bound", "flat")))
    )
    measured = {"MODEL_LABEL_DISAGREE": F.col("prob"), "STALE_CATALOGUE_FREQ": F.abs("offset_ppm"), "DEAD_CAPTURE": F.col("flat")}
    cells = F.array(
        *(F.struct(F.lit(k).alias("reason"), F.array_contains("reasons", k).alias("fired"), v.alias("value")) for k, v in measured.items())
    )
    return (
        c.select(F.explode(cells).alias("x"))
        .groupBy("x.reason")
        .agg(F.count_if("x.fired").alias("flagged"), F.count("x.value").alias("measurable"), F.round(F.max("x.value"), 9).alias("largest"))
        .withColumn("inert", F.col("flagged") == 0)
    )


def exclusion_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by what their label lets them be used for; the parts sum to the whole (O6.1)."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.count("*").alias("k"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").isNull().alias("missing")).join(labels, "doc_id", "left")
    fate = (
        F.when(F.col("missing"), "MISSING")
        .when(F.col("k").isNull(), "UNLABELLED")
        .when(F.col("quality") == 1, "POSITIVE")
        .when(F.col("quality") == 0, "NEGATIVE")
        .otherwise("UNKNOWN")
    )
    return d.groupBy(fate.alias("disposition")).agg(F.count("*").alias("n"))


def split_chronological(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.chronological(observations(spark, sf_dir)).select("obs_id", "episode", "partition")


def _cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir)
    station = splits.cold_entity(rows, "station").withColumnRenamed("partition", "by_station")
    both = splits.cold_entity(station, "transmitter").withColumnRenamed("partition", "by_transmitter")
    return both.withColumn("partition", splits.combined(F.col("by_station"), F.col("by_transmitter")))


def split_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cold(spark, sf_dir).select("obs_id", "by_station", "by_transmitter", "partition")


def split_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.composition(splits.chronological(observations(spark, sf_dir)))


def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"chronological": splits.chronological(observations(spark, sf_dir)), "cold_combined": _cold(spark, sf_dir)}
    return splits.leakage_audit(made, ["station", "transmitter", "episode"], {("chronological", "station"), ("chronological", "transmitter")})


def _documents_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("doc_id") % 3
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), splits.named(third).alias("partition"))


def duplicates_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.first_partition_wins(_documents_split(spark, sf_dir), "sha", "doc_id").select("doc_id", "partition")


def duplicates_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.exclude_duplicates(_documents_split(spark, sf_dir), "sha", "doc_id").select("doc_id", "partition")


def catalogue_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 7).alias("number"))
    return splits.islands(ids, "number", gap=7)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).where("prob is not null and label <> 'unknown'")
    return c.select("obs_id", "station", F.col("prob").alias("p"), (F.col("label") == "with-signal").cast("int").alias("y"))


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.scores(_judged(spark, sf_dir))


def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.reliability(_judged(spark, sf_dir))


def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.calibration_error(_judged(spark, sf_dir))


def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc(_judged(spark, sf_dir))


def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.risk_coverage(_judged(spark, sf_dir))


def risk_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.area_under(metrics.risk_coverage(_judged(spark, sf_dir)))


def intraclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.intraclass(_judged(spark, sf_dir), "station", "y")


def station_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, least and largest offset of each station and mode with three or more satellites (O6.17)."""
    c = candidates(spark, sf_dir).where("offset_ppm is not null and not at_bound")
    mode = F.when(F.col("spread") >= 0.5, "UNCORRECTED").otherwise("CORRECTED")
    rows = checkpoint(c.select("station", mode.alias("mode"), "offset_ppm", "label"))
    each = rows.groupBy("station", "mode").agg(
        F.count("*").alias("n"),
        F.round(F.min("offset_ppm"), 6).alias("least_ppm"),
        F.round(F.max("offset_ppm"), 6).alias("largest_ppm"),
        (F.count_distinct("label") >= 3).alias("calibrated"),
    )
    middle = percentiles(rows, "offset_ppm", {"median_ppm": 0.5}, ["station", "mode"])
    return each.join(middle, ["station", "mode"]).withColumn("median_ppm", F.round("median_ppm", 6))


def capture_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type: how many, over what span and how many a day (O6.23)."""
    e = table(spark, sf_dir, "events").select("event_type", records.seconds(F.col("ts")).alias("s"))
    span = F.max("s") - F.min("s")
    return e.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(span, 3).alias("span_s"), F.round(F.count("*") * 86400.0 / F.when(span > 0, span), 6).alias("per_day")
    )


def value_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, 10th, 50th and 90th percentile and largest value of each event type (O6.24)."""
    e = table(spark, sf_dir, "events").select("event_type", "value")
    at = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    return percentiles(e, "value", at, ["event_type"]).withColumns({name: F.round(name, 6) for name in at})


def value_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value").where("value is not null")
    return average_rank(e, "value", "rank", ["event_type"]).select("event_id", "event_type", "rank")


def event_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by receive band, the frequency read from their JSON properties (O3.9, O3.10)."""
    k = F.get_json_object("props", "$.k").cast("double")
    hz = F.when(k % 3 == 0, 145.0e6).when(k % 3 == 1, 435.0e6).otherwise(F.when(k % 2 == 0, 1.0e9))
    return table(spark, sf_dir, "events").groupBy(records.band(hz).alias("band")).agg(F.count("*").alias("n"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the host in their address (O3.8)."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    return table(spark, sf_dir, "pages").select("url").groupBy(host.alias("host")).agg(F.count("*").alias("n"))


def numbers_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", records.numbers_in(F.coalesce("text", F.lit(""))).alias("x"))
    return t.select("conv_id", "turn", F.size("x").cast("long").alias("n"), F.array_join("x", ",").alias("numbers"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("entity"), F.col("embedding").alias("vec"), "label")


def precedent_warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return precedent.nearest(v, v.where("id % 100 = 0"))


def precedent_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return precedent.nearest(v, v.where("id % 100 = 0"), metric="euclidean", cold=True)


def precedent_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return precedent.agreement(precedent.nearest(v, v.where("id % 100 = 0")), v.select("id", "label"))


def chance_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return precedent.chance_level(_vectors(spark, sf_dir))


def station_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return precedent.same_station(observations(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        review_queue,
        queue_ranking,
        queue_caps,
        queue_lift,
        reason_census,
        criteria_fired,
        exclusion_table,
        split_chronological,
        split_cold,
        split_composition,
        leakage_audit,
        duplicates_move,
        duplicates_exclude,
        catalogue_islands,
        score_table,
        reliability,
        calibration_error,
        auc,
        risk_coverage,
        risk_area,
        intraclass,
        station_offsets,
        capture_rate,
        value_percentiles,
        value_ranks,
        event_bands,
        url_parts,
        numbers_written,
        precedent_warm,
        precedent_cold,
        precedent_agreement,
        chance_level,
        station_history,
        sessions.event_sessions,
    )
} | inference.QUERIES | models.QUERIES | rates.QUERIES | sources.QUERIES | grounding.QUERIES

_OBS = """
obs AS (
    SELECT o_orderkey AS obs_id, o_custkey AS station, c_nationkey AS transmitter, o_orderdate AS start,
           CASE o_orderstatus WHEN 'F' THEN 'with-signal' WHEN 'O' THEN 'without-signal' ELSE 'unknown' END AS label,
           concat_ws(':', o_custkey, c_nationkey, year(o_orderdate)) AS episode
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""
_CAND = (
    _OBS
    + """,
agg AS (
    SELECT l_orderkey AS obs_id, count(*) AS n, sum(CAST(round(l_discount * 100) AS BIGINT)) AS d, sum(CAST(round(l_quantity) AS BIGINT)) AS q,
           max(CAST(round(l_quantity) AS BIGINT)) AS q_max, max(CAST(round(l_tax * 100) AS BIGINT)) AS t,
           max(CAST(round(l_discount * 100) AS BIGINT)) - min(CAST(round(l_discount * 100) AS BIGINT)) AS s,
           count(*) FILTER (WHERE l_returnflag = 'R') AS r
    FROM lineitem GROUP BY 1),
meas AS (
    SELECT obs_id, CASE WHEN r > 0 THEN d::DOUBLE / (n * 10::DOUBLE) END AS prob, (q::DOUBLE / n - 25::DOUBLE) * 2::DOUBLE AS offset_ppm,
           q_max >= 50 AS at_bound, t::DOUBLE / 40::DOUBLE AS flat, s::DOUBLE / 10::DOUBLE AS spread
    FROM agg),
cand AS (SELECT * FROM obs LEFT JOIN meas USING (obs_id)),
why AS (
    SELECT *, list_filter([
        CASE WHEN (label = 'without-signal' AND prob >= 0.75) OR (label = 'with-signal' AND prob <= 0.25) THEN 'MODEL_LABEL_DISAGREE' END,
        CASE WHEN NOT at_bound AND abs(offset_ppm) >= 20 THEN 'STALE_CATALOGUE_FREQ' END,
        CASE WHEN flat >= 0.15::DOUBLE THEN 'DEAD_CAPTURE' END,
        CASE WHEN at_bound THEN 'OFFSET_AT_BOUND' END], lambda x: x IS NOT NULL) AS fired
    FROM cand),
coded AS (SELECT *, CASE WHEN len(fired) = 0 THEN ['NO_REASON'] ELSE fired END AS reasons,
          list_has_any(fired, ['MODEL_LABEL_DISAGREE', 'STALE_CATALOGUE_FREQ', 'DEAD_CAPTURE']) AS conflict FROM why)"""
)
_RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2::DOUBLE) / count(*) OVER ()"
_SCORED = (
    _CAND
    + f""",
sig AS (
    SELECT *, coalesce(CASE label WHEN 'with-signal' THEN 1 - prob WHEN 'without-signal' THEN prob ELSE abs(prob - 0.5::DOUBLE) * 2 END, 0) AS s1,
           CASE WHEN at_bound THEN 0 ELSE coalesce(abs(offset_ppm), 0) END AS s2, coalesce(flat, 0) AS s3, coalesce(spread, 0) AS s4
    FROM coded),
scored AS (
    SELECT *, round({_RANK.format("s1")} * 0.40::DOUBLE + {_RANK.format("s2")} * 0.35::DOUBLE
        + {_RANK.format("s3")} * 0.15::DOUBLE + {_RANK.format("s4")} * 0.10::DOUBLE, 9) AS score
    FROM sig),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY episode ORDER BY score DESC, obs_id) = 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, obs_id) AS rank FROM best)"""
)
_CHRONO = (
    _OBS
    + """,
placed AS (SELECT *, row_number() OVER (ORDER BY start, obs_id) - 1 AS spot, count(*) OVER () AS n FROM obs),
cut AS (SELECT *, CASE WHEN spot < floor(n * 0.70::DOUBLE) THEN 0 WHEN spot < floor(n * 0.70::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 1 ELSE 2 END AS o FROM placed),
chrono AS (SELECT *, ['train', 'calibration', 'test'][CAST(min(o) OVER (PARTITION BY episode) AS BIGINT) + 1] AS partition FROM cut)"""
)


def _cold_sql(entity: str, out: str) -> str:
    return f"""
{out}_reps AS (
    SELECT {entity}, row_number() OVER (ORDER BY substr(md5('0:' || {entity}), 1, 12), {entity}) - 1 AS spot, count(*) OVER () AS n
    FROM (SELECT DISTINCT {entity} FROM obs WHERE {entity} IS NOT NULL)),
{out} AS (
    SELECT {entity}, CASE WHEN spot < greatest(1, floor(n * 0.15::DOUBLE)) THEN 'test'
        WHEN spot < 2 * greatest(1, floor(n * 0.15::DOUBLE)) THEN 'calibration' ELSE 'train' END AS p FROM {out}_reps)"""


_COLD = (
    _OBS
    + ","
    + _cold_sql("station", "cs")
    + ","
    + _cold_sql("transmitter", "ct")
    + """,
cold AS (
    SELECT obs.*, coalesce(cs.p, 'excluded') AS by_station, coalesce(ct.p, 'excluded') AS by_transmitter,
           CASE WHEN coalesce(cs.p, 'excluded') = coalesce(ct.p, 'excluded') THEN coalesce(cs.p, 'excluded') ELSE 'excluded' END AS partition
    FROM obs LEFT JOIN cs USING (station) LEFT JOIN ct USING (transmitter))"""
)
_DOCS = "docs AS (SELECT doc_id, sha256(text) AS sha, ['train', 'calibration', 'test'][doc_id % 3 + 1] AS partition FROM documents)"
_JUDGED = _CAND + ", judged AS (SELECT obs_id, station, prob AS p, CAST(label = 'with-signal' AS INT) AS y FROM cand WHERE prob IS NOT NULL AND label <> 'unknown')"
_BINS = " + ".join(f"CASE WHEN p >= {e!r}::DOUBLE THEN 1 ELSE 0 END" for e in metrics.bin_edges()[1:-1])
_REL = f"rel AS (SELECT {_BINS} AS bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS rate FROM judged GROUP BY 1)"
_CURVE = f"""
grid AS (SELECT unnest({[repr(t) for t in metrics.thresholds()]!r})::DOUBLE AS t),
curve AS (
    SELECT round(t, 6) AS threshold, count(*) AS kept, sum(CAST((p >= 0.5) <> (y = 1) AS INT)) AS errors,
           round(count(*)::DOUBLE / (SELECT count(*) FROM judged), 9) AS coverage,
           round(sum(CAST((p >= 0.5) <> (y = 1) AS INT))::DOUBLE / count(*), 9) AS risk
    FROM grid JOIN judged ON greatest(p, 1 - p) >= t GROUP BY t)"""
_VEC = "v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings)"


def _near(measure: str, rule: str) -> str:
    return f"""{_VEC}, near AS (
    SELECT q.id AS query_id, p.id, row_number() OVER (PARTITION BY q.id ORDER BY {measure}, p.id) AS rank
    FROM v q JOIN v p ON {rule} WHERE q.id % 100 = 0)"""


_WARM = _near("list_cosine_distance(q.e, p.e)", "q.id <> p.id")


def _spread(split: str, source: str, entity: str) -> str:
    bad = "'BY_DESIGN'" if (split, entity) in {("chronological", "station"), ("chronological", "transmitter")} else "'FAIL'"
    return f"""
    SELECT '{split}' AS split, '{entity}' AS entity, spread, examined, no_key, excluded,
           CASE WHEN examined = 0 THEN 'FAIL' WHEN spread = 0 THEN 'PASS' ELSE {bad} END AS result
    FROM (SELECT count(*) FILTER (WHERE k > 1) AS spread, count(*) AS examined FROM
            (SELECT count(DISTINCT partition) AS k FROM {source} WHERE partition <> 'excluded' AND {entity} IS NOT NULL GROUP BY {entity})),
         (SELECT count(*) FILTER (WHERE partition <> 'excluded' AND {entity} IS NULL) AS no_key, count(*) FILTER (WHERE partition = 'excluded') AS excluded FROM {source})"""


_AUDIT = " UNION ALL ".join(_spread(s, t, e) for s, t in (("chronological", "chrono"), ("cold_combined", "cold")) for e in ("station", "transmitter", "episode"))
_ORDERS = {
    "queue": "-score",
    "fifo": "obs_id",
    "confidence": "-coalesce(greatest(prob, 1 - prob), 0)",
    "physics": "-coalesce(abs(offset_ppm), -1)",
    "offset": "-CASE WHEN at_bound THEN 0 ELSE coalesce(abs(offset_ppm), 0) END",
}
_LIFT = " UNION ALL ".join(
    f"SELECT '{name}' AS ordering, (SELECT count(*) FILTER (WHERE conflict) FROM (SELECT conflict FROM scored ORDER BY {by}, obs_id LIMIT {BUDGET})) AS found"
    for name, by in _ORDERS.items()
)

ORACLES = {
    "review_queue": f"""WITH {_SCORED}
        SELECT CAST(rank AS INT) AS rank, obs_id, episode, station, label, score, array_to_string(reasons, ',') AS reasons, conflict FROM ranked WHERE rank <= {BUDGET}""",
    "queue_ranking": f"WITH {_SCORED} SELECT obs_id, score, conflict, rank FROM ranked",
    "queue_caps": f"""WITH RECURSIVE {_SCORED}, rk AS MATERIALIZED (SELECT rank, obs_id, station, transmitter FROM ranked),
        step AS (
            SELECT CAST(0 AS BIGINT) AS rank, CAST([] AS BIGINT[]) AS st, CAST([] AS BIGINT[]) AS tr, 0 AS n, false AS admitted, false AS by_station, false AS by_transmitter
            UNION ALL
            SELECT rank, CASE WHEN ok AND station IS NOT NULL THEN list_append(st, station) ELSE st END, CASE WHEN ok AND transmitter IS NOT NULL THEN list_append(tr, transmitter) ELSE tr END,
                   n + CAST(ok AS INT), ok, full_st, full_tr
            FROM (SELECT rk.rank, station, transmitter, st, tr, n,
                         len(list_filter(st, lambda x: x = station)) >= 5 AS full_st, len(list_filter(tr, lambda x: x = transmitter)) >= 10 AS full_tr, NOT full_st AND NOT full_tr AS ok
                  FROM step JOIN rk ON rk.rank = step.rank + 1 WHERE n < {BUDGET}))
        SELECT rk.obs_id, rk.rank, station, transmitter, coalesce(admitted, false) AS admitted, coalesce(by_station, false) AS by_station, coalesce(by_transmitter, false) AS by_transmitter
        FROM rk LEFT JOIN step ON step.rank = rk.rank""",
    "queue_lift": f"""WITH {_SCORED}, o AS ({_LIFT}),
        w AS (SELECT count(*) AS n, count(*) FILTER (WHERE conflict) AS conflicts FROM scored)
        SELECT ordering, found, n, conflicts, CASE WHEN conflicts > 0 THEN round(found / (least({BUDGET}, n) * conflicts::DOUBLE / n), 9) END AS lift FROM o, w""",
    "reason_census": f"WITH {_CAND} SELECT reason, label, count(*) AS n FROM (SELECT unnest(reasons) AS reason, label FROM coded) GROUP BY ALL",
    "criteria_fired": f"""WITH {_CAND}, x AS (
        SELECT 'MODEL_LABEL_DISAGREE' AS reason, list_contains(reasons, 'MODEL_LABEL_DISAGREE') AS f, prob AS v FROM coded
        UNION ALL SELECT 'STALE_CATALOGUE_FREQ', list_contains(reasons, 'STALE_CATALOGUE_FREQ'), abs(offset_ppm) FROM coded
        UNION ALL SELECT 'DEAD_CAPTURE', list_contains(reasons, 'DEAD_CAPTURE'), flat FROM coded)
        SELECT reason, count(*) FILTER (WHERE f) AS flagged, count(v) AS measurable, round(max(v), 9) AS largest, count(*) FILTER (WHERE f) = 0 AS inert
        FROM x GROUP BY reason""",
    "exclusion_table": """
        WITH l AS (SELECT doc_id, max(quality) AS quality, count(*) AS k FROM labels GROUP BY 1)
        SELECT CASE WHEN text IS NULL THEN 'MISSING' WHEN k IS NULL THEN 'UNLABELLED' WHEN quality = 1 THEN 'POSITIVE'
            WHEN quality = 0 THEN 'NEGATIVE' ELSE 'UNKNOWN' END AS disposition, count(*) AS n
        FROM documents LEFT JOIN l USING (doc_id) GROUP BY 1""",
    "split_chronological": f"WITH {_CHRONO} SELECT obs_id, episode, partition FROM chrono",
    "split_cold": f"WITH {_COLD} SELECT obs_id, by_station, by_transmitter, partition FROM cold",
    "split_composition": f"""WITH {_CHRONO}
        SELECT partition, count(*) AS n, count(*) FILTER (WHERE label = 'with-signal') AS with_signal, count(*) FILTER (WHERE label = 'without-signal') AS without_signal,
            count(*) FILTER (WHERE label = 'unknown') AS unknown, count(DISTINCT station) AS stations, count(DISTINCT transmitter) AS transmitters,
            count(DISTINCT CAST(start AS DATE)) AS days FROM chrono GROUP BY 1""",
    "leakage_audit": f"WITH {_CHRONO}, {_COLD.replace(_OBS + ',', '')} {_AUDIT}",
    "duplicates_move": f"""WITH {_DOCS}
        SELECT doc_id, CASE WHEN sha IS NULL THEN partition ELSE first(partition) OVER (PARTITION BY sha ORDER BY doc_id) END AS partition FROM docs""",
    "duplicates_exclude": f"""WITH {_DOCS}
        SELECT doc_id, CASE WHEN sha IS NOT NULL AND row_number() OVER (PARTITION BY sha ORDER BY doc_id) > 1 THEN 'excluded' ELSE partition END AS partition FROM docs""",
    "catalogue_islands": """
        WITH d AS (SELECT DISTINCT o_custkey * 7 AS number FROM orders WHERE o_custkey IS NOT NULL),
        s AS (SELECT number, CASE WHEN number - lag(number) OVER (ORDER BY number) > 7 THEN 1 ELSE 0 END AS fresh FROM d),
        i AS (SELECT number, sum(fresh) OVER (ORDER BY number) AS g FROM s)
        SELECT number, min(number) OVER (PARTITION BY g) AS rep FROM i""",
    "score_table": f"""WITH {_JUDGED}, q AS (SELECT p, y, greatest(least(p, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE) AS q FROM judged)
        SELECT count(*) AS n, round(avg((p - y) * (p - y)), 9) AS brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 9) AS log_loss FROM q""",
    "reliability": f"WITH {_JUDGED}, {_REL} SELECT * FROM rel",
    "calibration_error": f"WITH {_JUDGED}, {_REL} SELECT round(sum(abs(mean_p - rate) * n) / sum(n), 6) AS ece FROM rel",
    "auc": f"""WITH {_JUDGED}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2::DOUBLE AS r FROM judged),
        s AS (SELECT sum(r) FILTER (WHERE y = 1) AS s, count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0 FROM r)
        SELECT n1, n0, CASE WHEN n1 > 0 AND n0 > 0 THEN round((s - n1 * (n1 + 1) / 2::DOUBLE) / (n1 * n0), 9) END AS auc FROM s""",
    "risk_coverage": f"WITH {_JUDGED}, {_CURVE} SELECT threshold, kept, CAST(errors AS BIGINT) AS errors, coverage, risk FROM curve",
    "risk_area": f"""WITH {_JUDGED}, {_CURVE}, p AS (
        SELECT coverage, (coverage - lag(coverage) OVER w) * (risk + lag(risk) OVER w) / 2 AS step FROM curve WINDOW w AS (ORDER BY coverage, threshold DESC))
        SELECT CASE WHEN max(coverage) > min(coverage) THEN round(sum(step) / (max(coverage) - min(coverage)), 6) END AS aurc FROM p""",
    "intraclass": f"""WITH {_JUDGED}, g AS (SELECT count(*)::DOUBLE AS g, sum(y)::DOUBLE AS s, sum(y * y)::DOUBLE AS ss FROM judged GROUP BY station),
        t AS (SELECT count(*) AS k, sum(g) AS n, sum(g * g) AS g2, sum(s) AS s, sum(ss) AS ss, sum(s * s / g) AS b FROM g),
        m AS (SELECT k, n, (b - s * s / n) / (k - 1) AS mb, (ss - b) / (n - k) AS mw, (n - g2 / n) / (k - 1) AS n0 FROM t),
        i AS (SELECT *, (mb - mw) / (mb + (n0 - 1) * mw) AS icc FROM m)
        SELECT k, CAST(n AS BIGINT) AS n, round(n0, 6) AS n0, round(icc, 6) AS icc, round(1 + (n / k - 1) * icc, 6) AS design_effect FROM i""",
    "station_offsets": f"""WITH {_CAND}
        SELECT station, CASE WHEN spread >= 0.5 THEN 'UNCORRECTED' ELSE 'CORRECTED' END AS mode, count(*) AS n, round(quantile_cont(offset_ppm, 0.5), 6) AS median_ppm,
            round(min(offset_ppm), 6) AS least_ppm, round(max(offset_ppm), 6) AS largest_ppm, count(DISTINCT label) >= 3 AS calibrated
        FROM cand WHERE offset_ppm IS NOT NULL AND NOT at_bound GROUP BY 1, 2""",
    "capture_rate": """
        WITH e AS (SELECT event_type, epoch_us(ts) / 1e6::DOUBLE AS s FROM events)
        SELECT event_type, count(*) AS n, round(max(s) - min(s), 3) AS span_s,
            CASE WHEN max(s) > min(s) THEN round(count(*) * 86400::DOUBLE / (max(s) - min(s)), 6) END AS per_day FROM e GROUP BY 1""",
    "value_percentiles": """
        SELECT event_type, round(quantile_cont(value, 0.0), 6) AS p0, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50,
            round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 1.0), 6) AS p100 FROM events GROUP BY 1""",
    "value_ranks": """
        SELECT event_id, event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2::DOUBLE AS rank
        FROM events WHERE value IS NOT NULL""",
    "event_bands": """
        WITH e AS (SELECT CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
        SELECT CASE WHEN k % 3 = 0 THEN 'vhf_2m' WHEN k % 3 = 1 THEN 'uhf_70cm' WHEN k % 2 = 0 THEN 'other' ELSE 'unknown' END AS band, count(*) AS n FROM e GROUP BY 1""",
    "url_parts": "SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1",
    "numbers_written": r"""
        WITH t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(coalesce(text, ''), '-?[0-9]+(?:\.[0-9]+)?'),
            lambda x: CASE WHEN contains(x, '.') THEN regexp_replace(x, '\.?0+$', '') ELSE x END) AS x FROM conversations)
        SELECT conv_id, turn, len(x) AS n, array_to_string(x, ',') AS numbers FROM t""",
    "precedent_warm": f"WITH {_WARM} SELECT query_id, id, CAST(rank AS INT) AS rank FROM near WHERE rank <= 5",
    "precedent_cold": f"WITH {_near('list_distance(q.e, p.e)', 'q.id <> p.id AND q.label IS DISTINCT FROM p.label')} SELECT query_id, id, CAST(rank AS INT) AS rank FROM near WHERE rank <= 5",
    "precedent_agreement": f"""WITH {_WARM}
        SELECT query_id, round(avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END), 9) AS agreement
        FROM near JOIN v a ON a.id = near.id JOIN v b ON b.id = query_id WHERE rank <= 5 GROUP BY 1""",
    "chance_level": "SELECT round(sum(k * k)::DOUBLE / (sum(k) * sum(k)), 9) AS chance FROM (SELECT count(*) AS k FROM embeddings GROUP BY label)",
    "station_history": f"""WITH {_OBS}, n AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY start, obs_id) AS i FROM obs WHERE station IS NOT NULL)
        SELECT q.obs_id AS query_id, p.obs_id AS id, CAST(q.i - p.i AS INT) AS rank FROM n q JOIN n p ON p.station = q.station AND p.i BETWEEN q.i - 5 AND q.i - 1""",
    "event_sessions": sessions.SESSIONS_SQL,
}
ORACLES |= inference.oracles(_OBS, _CAND, _SCORED, _CHRONO) | models.oracles(_CAND) | rates.oracles(_CAND) | sources.ORACLES | grounding.oracles(_CAND)
