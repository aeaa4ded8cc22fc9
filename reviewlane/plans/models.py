"""Queries of fitted models and calibrators, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlane.functions.materialize import checkpoint
from reviewlane.operators import calibration, models, splits
from reviewlane.sources.tables import candidates

NUMERIC, CATEGORICAL = ["prob", "offset_ppm", "flat", "spread"], ["transmitter"]


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with their measurements, part and label."""
    rows = splits.chronological(candidates(spark, sf_dir).where("label <> 'unknown'"))
    return checkpoint(rows.select("obs_id", "station", "transmitter", "episode", "partition", *NUMERIC, (F.col("label") == "with-signal").cast("int").alias("y")))


def _fitted(rows: DataFrame) -> tuple[models.Design, models.Logistic]:
    train = rows.where("partition = 'train'")
    design = models.fit_design(train, NUMERIC, CATEGORICAL)
    held = train.select(design.features().alias("x"), "y", F.array(F.lit(1.0)).alias("w"))
    return design, models.fit(held, len(design.columns))[0]


def model_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, weight of each column and the intercept, fitted on the training part; NumPy tests, as SQL has no solver."""
    design, model = _fitted(_judged(spark, sf_dir))
    named = [(c, float(w)) for c, w in zip(design.columns, model.weights)] if model.weights is not None else []
    out = spark.createDataFrame([*named, ("intercept", model.intercept)], "name string, weight double")
    return out.select("name", F.round("weight", 6).alias("weight"))


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir)
    design, model = _fitted(rows)
    return rows.withColumn("x", design.features()).select("obs_id", "partition", "y", F.round(models.predicted(model), 6).alias("p"))


def model_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all labelled rows by models that saw no row of their station."""
    rows = _judged(spark, sf_dir)
    design = models.fit_design(rows, NUMERIC, CATEGORICAL)
    out = models.out_of_fold(rows.withColumn("x", design.features()), "x", "y", "station", "obs_id", len(design.columns))
    return out.select("obs_id", "fold", F.round("p", 6).alias("p"))


def station_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the folds: stations dealt by their number of rows."""
    rows = candidates(spark, sf_dir).where("label <> 'unknown'").select("station")
    folds = models.fold_of_groups(rows, "station", 5)
    sizes = rows.groupBy(F.col("station").cast("string").alias("station")).agg(F.count("*").alias("n"))
    return folds.join(sizes, "station").groupBy("fold").agg(F.count("*").alias("stations"), F.sum("n").alias("n"))


def model_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and spread over members that were fitted on resampled episodes."""
    rows = _judged(spark, sf_dir)
    train = rows.where("partition = 'train'")
    design = models.fit_design(train, NUMERIC, CATEGORICAL)
    featured = lambda df: df.withColumn("x", design.features())
    out = models.ensemble(featured(train), featured(rows), "x", "y", "episode", "obs_id", len(design.columns))
    return out.select("obs_id", "members", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir).where("prob is not null and label <> 'unknown'")
    return rows.select("obs_id", F.col("prob").alias("p"), (F.col("label") == "with-signal").cast("int").alias("y"))


def calibration_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.slope_intercept(_predictions(spark, sf_dir))
    return out.select("n", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


def _calibration_part(rows: DataFrame) -> DataFrame:
    return rows.where("obs_id % 2 = 1")


def isotonic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = calibration.isotonic_blocks(_predictions(spark, sf_dir))
    return out.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "n", "n1")


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All predictions by the isotonic calibrator of the rows with odd numbers."""
    rows = _predictions(spark, sf_dir)
    out = calibration.fit(_calibration_part(rows), "isotonic").apply(rows, "p", "calibrated")
    return out.select("obs_id", F.round("calibrated", 9).alias("calibrated"))


def calibration_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calibration.fit(_predictions(spark, sf_dir), "temperature")
    values = (round(found.temperature, 6), round(found.bias, 6), round(found.log_loss, 9))
    return spark.createDataFrame([values], "temperature double, bias double, log_loss double")


QUERIES = {f.__name__: f for f in (model_fit, model_scores, model_folds, station_folds, model_ensemble, calibration_slope, isotonic_blocks, calibrated, calibration_temperature)}


def oracles(cand: str) -> dict[str, str]:
    """SQL by query name; cand: the registry's common table expression of candidates."""
    rows = cand + ", judged AS (SELECT obs_id, prob AS p, CAST(label = 'with-signal' AS INT) AS y FROM cand WHERE prob IS NOT NULL AND label <> 'unknown')"
    isotonic = lambda where: f"""c AS (SELECT p, count(*) AS n, sum(y) AS n1, row_number() OVER (ORDER BY p) AS i FROM judged WHERE {where} GROUP BY p),
        s AS (SELECT *, sum(n) OVER (ORDER BY i) AS sn, sum(n1) OVER (ORDER BY i) AS s1 FROM c),
        m AS (SELECT a.i AS a, b.i AS b, (b.s1 - a.s1 + a.n1)::DOUBLE / (b.sn - a.sn + a.n) AS mean FROM s a JOIN s b ON a.i <= b.i),
        f AS (SELECT i, any_value(p) AS p, any_value(n) AS n, any_value(n1) AS n1, max(least) AS v
              FROM (SELECT s.i, s.p, s.n, s.n1, m.a, min(mean) AS least FROM s JOIN m ON m.a <= s.i AND m.b >= s.i GROUP BY ALL) GROUP BY i)"""  # noqa: E731
    odds = "ln(greatest(least(p, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE) / (1 - greatest(least(p, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE)))"
    return {
        "station_folds": f"""WITH RECURSIVE {cand}, g AS (SELECT station, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST(station AS VARCHAR)) AS i FROM cand WHERE label <> 'unknown' GROUP BY 1),
            w(i, loads, fold) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], NULL::INT UNION ALL
                SELECT w.i + 1, list_transform(loads, lambda x, k: CASE WHEN k = list_position(loads, list_min(loads)) THEN x + n ELSE x END), list_position(loads, list_min(loads)) - 1 FROM w JOIN g ON g.i = w.i + 1)
            SELECT fold, count(*) AS stations, CAST(sum(n) AS BIGINT) AS n FROM w JOIN g USING (i) GROUP BY fold""",
        "calibration_slope": f"""WITH RECURSIVE {rows}, c AS MATERIALIZED (SELECT {odds} AS z, count(*) AS n, sum(y) AS n1 FROM judged GROUP BY p),
            b(i, s, t) AS (SELECT 0, 0::DOUBLE, 0::DOUBLE UNION ALL
                SELECT i + 1, s + (htt * gs - hst * gt) / (hss * htt - hst * hst), t + (hss * gt - hst * gs) / (hss * htt - hst * hst) FROM (
                    SELECT i, s, t, sum((n1 - n * q) * z) AS gs, sum(n1 - n * q) AS gt, sum(n * q * (1 - q) * z * z) AS hss, sum(n * q * (1 - q) * z) AS hst, sum(n * q * (1 - q)) AS htt
                    FROM (SELECT b.*, c.*, 1 / (1 + exp(-(s * z + t))) AS q FROM b, c WHERE i < 25) GROUP BY i, s, t))
            SELECT (SELECT count(*) FROM judged) AS n, round(s, 6) AS slope, round(t, 6) AS intercept FROM b WHERE i = 25""",
        "isotonic_blocks": f"WITH {rows}, {isotonic('true')} SELECT round(min(p), 9) AS low, round(max(p), 9) AS high, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n1) AS BIGINT) AS n1 FROM f GROUP BY v",
        "calibrated": f"""WITH {rows}, {isotonic('obs_id % 2 = 1')}, q AS (SELECT DISTINCT p FROM judged),
            n AS (SELECT q.p, (SELECT max(f.p) FROM f WHERE f.p <= q.p) AS a, (SELECT min(f.p) FROM f WHERE f.p >= q.p) AS b FROM q),
            v AS (SELECT n.p, CASE WHEN a IS NULL THEN y.v WHEN b IS NULL OR a = b THEN x.v ELSE x.v + (y.v - x.v) * (n.p - a) / (b - a) END AS v FROM n LEFT JOIN f x ON x.p = a LEFT JOIN f y ON y.p = b)
            SELECT obs_id, round(least(greatest(v, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE), 9) AS calibrated FROM judged JOIN v USING (p)""",
        "calibration_temperature": f"""WITH {rows}, c AS (SELECT {odds} AS z, count(*) AS n, sum(y) AS n1 FROM judged GROUP BY p),
            g AS (SELECT 0.25::DOUBLE + i * 0.05::DOUBLE AS temperature, -2::DOUBLE + j * 0.05::DOUBLE AS bias FROM range(0, 76) a(i), range(0, 81) b(j)),
            l AS (SELECT temperature, bias, sum(-n1 * ln(s) - (n - n1) * ln(1 - s)) / sum(n) AS loss FROM (
                SELECT g.*, c.*, least(greatest(1 / (1 + exp(-(z / temperature + bias))), 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS s FROM g, c) GROUP BY ALL)
            SELECT round(temperature, 6) AS temperature, round(bias, 6) AS bias, round(loss, 9) AS log_loss FROM l ORDER BY round(loss, 11), temperature, bias LIMIT 1""",
    }
