"""Labels with their origin, and which fields of a record may become features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The states of a label.
POSITIVE, NEGATIVE, UNLABELLED = "positive", "negative", "unlabelled"
ABSENT, UNVETTED, UNKNOWN = "absent", "unvetted", "unknown"
VETTED_BY_HUMAN, NOT_VETTED, MISSING, USABLE = "satnogs_vet", "satnogs_unvet", "missing", "usable"
LICENSE = "CC BY-SA 4.0"


def label_states(url: Column, vetted: Column) -> Column:
    """label_outcome, trace_presence, label_origin and artifact_status of a record (O3.4).

    Without an image nothing was vetted, whatever the record says; an unvetted record is
    never a negative.
    """
    missing = F.coalesce(url, F.lit("")) == ""

    def state(no_image: str, yes: str, no: str, open_: str) -> Column:
        return F.when(missing, no_image).when(vetted == "with-signal", yes).when(vetted == "without-signal", no).otherwise(open_)

    return F.struct(
        state(UNLABELLED, POSITIVE, NEGATIVE, UNLABELLED).alias("label_outcome"),
        state(UNKNOWN, UNVETTED, ABSENT, UNVETTED).alias("trace_presence"),
        state(MISSING, VETTED_BY_HUMAN, VETTED_BY_HUMAN, NOT_VETTED).alias("label_origin"),
        F.when(missing, MISSING).otherwise(USABLE).alias("artifact_status"),
    )


def labelled(rows: DataFrame, skip_future: bool = True) -> DataFrame:
    """rows (status, url, vetted, ended, retrieved) with the label's states, flags and the lag of its vetting (O3.4, O3.5).

    Passes that are still to come have no label: they are left out, or, without skip_future,
    stop the query.
    """
    future = F.coalesce(F.col("status") == "future", F.lit(False))
    if skip_future:
        rows = rows.where(~future)
    else:
        rows = rows.withColumn("status", F.when(future, F.raise_error(F.lit("a future observation has no label"))).otherwise(F.col("status")))
    stated = rows.withColumn("state", label_states(F.col("url"), F.col("vetted")))
    outcome = F.col("state.label_outcome")
    return stated.select(
        *rows.columns,
        "state.*",
        (outcome == POSITIVE).alias("labelled_positive"),
        F.lit(False).alias("carries_measurable_trace"),  # only a measurement can say so
        outcome.isin(POSITIVE, NEGATIVE).alias("eligible_for_training"),
        (F.unix_micros(F.col("retrieved").cast("timestamp")) - F.unix_micros(F.col("ended").cast("timestamp"))).alias("lag_us"),
    )


def broken_invariants(rows: DataFrame) -> DataFrame:
    """One row: how many labelled rows contradict themselves, by rule; all are zero for rows of labelled()."""
    outcome, missing = F.col("label_outcome"), F.col("artifact_status") == MISSING
    decisive = F.coalesce(F.col("vetted").isin("with-signal", "without-signal"), F.lit(False))
    rules = {
        "flag_disagrees": F.col("labelled_positive") != (outcome == POSITIVE),
        "decisive_but_unlabelled": (outcome == UNLABELLED) & decisive & ~missing,
        "label_without_vetting": outcome.isin(POSITIVE, NEGATIVE) & ~decisive,
        "label_without_image": outcome.isin(POSITIVE, NEGATIVE) & missing,
    }
    return rows.agg(F.count("*").alias("n"), *(F.count_if(rule).alias(name) for name, rule in rules.items()))


def receipt(rows: DataFrame) -> DataFrame:
    """obs_id and the provenance part of a receipt as JSON text, nulls written out (O3.6)."""
    fields = F.struct(
        F.coalesce("source_url", F.lit("")).alias("source_url"),
        F.coalesce(F.date_format("retrieved", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("retrieved_at"),
        F.lit(LICENSE).alias("license"),
        F.col("vetted").alias("api_label"),
        "label_origin",
        F.col("sha256").alias("artifact_sha256"),
        F.col("partition").alias("split"),
        F.col("station").alias("station_id"),
        F.col("transmitter").alias("transmitter_uuid"),
    )
    return rows.select("obs_id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("provenance"))


def field_census(records: DataFrame, json: str, classes: DataFrame) -> DataFrame:
    """field, n, kind: every field that any JSON record has, with its class or null (O4.10)."""
    keys = records.select(F.explode(F.map_keys(F.from_json(json, "map<string,string>"))).alias("field"))
    return keys.groupBy("field").agg(F.count("*").alias("n")).join(F.broadcast(classes.select("field", "kind")), "field", "left")  # the classification


def classification(census: DataFrame) -> DataFrame:
    """One row: whether every field has a class, how many there are and which have none; none at all stops the query (O4.10, O9.3)."""
    counted = census.agg(
        F.count("*").alias("n_examined"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("kind").isNull(), F.col("field")))), ",").alias("unclassified"),
        F.count_if(F.col("kind") == "post_observation").alias("n_forbidden"),
    )
    some = F.when(F.col("n_examined") > 0, F.col("n_examined")).otherwise(F.raise_error(F.lit("no records to classify")).cast("long"))
    return counted.select((F.col("unclassified") == "").alias("passed"), some.alias("n_examined"), "unclassified", "n_forbidden")


def inadmissible(blocks: DataFrame, classes: DataFrame) -> DataFrame:
    """block, field, kind of fields that a block reads and may not: of another class than observation_time, or of none (O4.11)."""
    joined = blocks.join(F.broadcast(classes.select("field", "kind")), "field", "left")  # the classification
    return joined.where(F.coalesce(F.col("kind"), F.lit("")) != "observation_time").select("block", "field", F.coalesce("kind", F.lit("unclassified")).alias("kind"))


def broken_links(log: DataFrame, chain: str, order: str) -> DataFrame:
    """chain, n, broken: entries whose digest of the entry before, or own digest, is wrong (O2.6, O2.7, O7.10).

    log has `record` (text), `prev` and `digest` (hexadecimal); the first entry of a chain has no `prev`.
    """
    before = F.lag("digest").over(Window.partitionBy(chain).orderBy(order))
    own = F.sha2(F.concat(F.coalesce("prev", F.lit("")), F.col("record")), 256)
    checked = log.withColumn("linked", F.col("prev").eqNullSafe(before) & (F.col("digest") == own))
    return checked.groupBy(chain).agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("broken"))
