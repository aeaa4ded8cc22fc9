"""Resumable ingestion: a stream of fetched entries into a table, with failed fetches asked for again.

Each micro-batch is written under its own number, so a batch that is repeated after a failure
replaces itself. An entry is settled unless its reason is transient; the current entry of a key
is the last settled one, or the last transient one while none is settled. Restarted over the
same folder the stream goes on behind the last batch, and what is still to be fetched are the
requests without a settled entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Reasons of a failed fetch that a later one may not meet.
TRANSIENT = ["THROTTLED", "TIMEOUT", "HTTP_ERROR"]


def is_transient(reason: Column) -> Column:
    """Whether a failed entry is worth another request (O4.1); no reason is none."""
    return F.coalesce(reason.isin(TRANSIENT), F.lit(False))


def ingest(spark: SparkSession, source: str, folder: str, schema: str, files: int = 1000) -> None:
    """Take in all files of `source` (Parquet) that are new to the table in folder/entries (O15.2)."""
    entries = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/entries/batch={number:09d}")

    query = entries.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, folder: str, schema: str, key: str, reason: str = "reason", order: str = "seen") -> DataFrame:
    """One row for each key: its last settled entry by batch and order, else its last transient one (O3.3).

    The aggregate combines before the exchange, so a key with many entries is one row a task.
    """
    fields = spark.createDataFrame([], schema).columns
    read = spark.read.schema(f"{schema}, batch string").parquet(f"{folder}/entries")
    place = F.struct(~is_transient(F.col(reason)), F.col("batch"), F.col(order))
    return read.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*fields), place).alias("e")).select("e.*")


def to_request(requests: DataFrame, held: DataFrame, key: str, reason: str = "reason") -> DataFrame:
    """The requests without a settled entry: new ones, and those whose last fetch failed for a transient reason (O5.3)."""
    return requests.join(held.where(~is_transient(F.col(reason))).select(key), key, "left_anti")
