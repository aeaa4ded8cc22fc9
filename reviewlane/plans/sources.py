"""Queries over snapshots that Spark writes from the tables, pair counts, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlane.functions.materialize import shared_folder
from reviewlane.operators import census
from reviewlane.sources import snapshot
from reviewlane.sources.tables import table
from reviewlane.streaming import ingest

RECORD = "obs_id long, station long, status string"
PAGE_ROWS = 5000


def _captured(spark: SparkSession, sf_dir: str) -> str:
    """A folder of JSON pages of the orders; every fifth order stands on a later page again, with another status."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs_id"), F.col("o_custkey").alias("station"), F.col("o_orderstatus").alias("status"))
    pages = max(16, -(-o.count() // PAGE_ROWS))
    page = F.pmod(F.xxhash64("obs_id"), F.lit(pages))
    again = o.where("obs_id % 5 = 0").withColumn("status", F.lit("seen again"))
    both = o.withColumn("page", page).unionByName(again.withColumn("page", page + pages))
    arrays = both.groupBy("page").agg(F.to_json(F.collect_list(F.struct("obs_id", "station", "status"))).alias("value"))  # some PAGE_ROWS records
    folder = f"{shared_folder(spark)}/snapshots/{uuid.uuid4().hex}"
    arrays.withColumn("page", F.format_string("page %09d", "page")).write.partitionBy("page").text(folder)
    return folder


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.load_pages(spark, _captured(spark, sf_dir), RECORD, "obs_id", "*.txt")


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders but every seventh."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs_id")).where("obs_id % 7 <> 0")


def snapshot_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that the manifest names, as their last page has them."""
    return snapshot.load_snapshot(_pages(spark, sf_dir), _manifest(spark, sf_dir), "obs_id")


def snapshot_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.orphans(_pages(spark, sf_dir), _manifest(spark, sf_dir), "obs_id")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and refused lines of a log of the events, of which every tenth is cut short."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    line = F.to_json(F.struct("event_id", "event_type"))
    folder = f"{shared_folder(spark)}/logs/{uuid.uuid4().hex}"
    e.select(F.when(F.col("event_id") % 10 == 0, F.left(line, F.lit(9))).otherwise(line).alias("value")).write.text(folder)
    lines = snapshot.read_lines(spark, folder, "event_id long, event_type string")
    good = F.col("record").isNotNull()
    return lines.agg(F.count("*").alias("n"), F.count_if(~good).alias("refused"), F.sum("record.event_id").alias("ids"))


ENTRY = "obs_id long, sha string, reason string, seen long"


def _fetched(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The folder of a stream that took in two waves of fetches, started anew for the second; and the requests.

    The first wave asks for the orders whose number is not divisible by four. Every third fetch
    fails: for good if the number is divisible by five, else until the second wave, which
    fetches all that is to be requested by then.
    """
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs_id"))
    folder = f"{shared_folder(spark)}/fetched/{uuid.uuid4().hex}"
    sha = F.sha2(F.col("obs_id").cast("string"), 256)
    failed = F.col("obs_id") % 3 == 0
    gone = F.when(failed & (F.col("obs_id") % 5 == 0), "NOT_FOUND")
    for wave in (0, 1):
        asked = requests.where("obs_id % 4 <> 0") if wave == 0 else ingest.to_request(requests, ingest.current(spark, folder, ENTRY, "obs_id"), "obs_id")
        reason = F.coalesce(gone, F.when(failed, "TIMEOUT")) if wave == 0 else gone
        entries = asked.withColumn("reason", reason).select("obs_id", F.when(F.col("reason").isNull(), sha).alias("sha"), "reason", F.lit(wave).cast("long").alias("seen"))
        entries.write.mode("append").parquet(f"{folder}/in")
        ingest.ingest(spark, f"{folder}/in", folder, ENTRY)
    return folder, requests


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = _fetched(spark, sf_dir)
    return ingest.current(spark, folder, ENTRY, "obs_id")


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by nation (site), customer (station) and priority (satellite; the lowest is unknown)."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("station"), F.col("c_nationkey").alias("site"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("station"), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("satellite"))
    return o.join(c, "station", "left")


def pair_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with several stations, and the pairs that only the rule of the site keeps apart."""
    rows = _sites(spark, sf_dir)
    return census.shared_sites(rows, "site", "station").join(F.broadcast(census.pairs_only_excluded_by(rows, "site", ["station", "satellite"])))  # one row each


QUERIES = {f.__name__: f for f in (snapshot_records, snapshot_orphans, log_lines, ingested, pair_census)}

ORACLES = {
    "snapshot_records": "SELECT o_orderkey AS obs_id, o_custkey AS station, CASE WHEN o_orderkey % 5 = 0 THEN 'seen again' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 7 <> 0",
    "snapshot_orphans": "SELECT count(*) AS records, count(*) FILTER (WHERE o_orderkey % 7 <> 0) AS named, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS orphans FROM orders",
    "log_lines": "SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 10 = 0) AS refused, CAST(sum(event_id) FILTER (WHERE event_id % 10 <> 0) AS BIGINT) AS ids FROM events",
    "ingested": """SELECT o_orderkey AS obs_id, CASE WHEN reason IS NULL THEN sha256(CAST(o_orderkey AS VARCHAR)) END AS sha, reason, CAST(CASE WHEN o_orderkey % 4 = 0 OR (o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0) THEN 1 ELSE 0 END AS BIGINT) AS seen
        FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 15 = 0 THEN 'NOT_FOUND' END AS reason FROM orders)""",
    "pair_census": """WITH s AS (SELECT o_orderkey AS id, c_nationkey AS site, o_custkey AS station, nullif(o_orderpriority, '5-LOW') AS satellite FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
        t AS (SELECT site, count(DISTINCT station) AS stations, count(*) AS n FROM s WHERE site IS NOT NULL GROUP BY 1)
        SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_sites, count(*) FILTER (WHERE stations > 1) AS n_shared, CAST(coalesce(sum(stations) FILTER (WHERE stations > 1), 0) AS BIGINT) AS stations_there,
            CAST(coalesce(sum(n) FILTER (WHERE stations > 1), 0) AS BIGINT) AS rows_there,
            (SELECT count(*) FROM s a JOIN s b ON a.site = b.site AND a.id <> b.id WHERE (a.station = b.station) IS NOT TRUE AND (a.satellite = b.satellite) IS NOT TRUE) AS pairs FROM t""",
}
