"""Exact deduplication by streams with keyed state.

Texts are equal when they are identical without ASCII white space. A first stream reads the
table's files as they come and appends a row per document to a table of digests: SHA-256 of the
normalised text, the document's id, its length and its locator (file and row). A second stream
reads that table and keeps state by digest on disk (RocksDB, in the checkpoint's folder), without
watermark or expiry: how many rows the digest has, and the identifier and the locator of the row
that stays - the one with the most code points, then the smallest id. Both streams go on where
they stopped when they are started again over the same folder, and read only files that are new.

A hit is a row whose digest the state counts more than once. The full bytes of all hits are
compared with the content that the state's locator points to; texts are pre-aggregated by digest
and bytes, so a group of copies costs one row a task. Bytes that differ under one digest are
dealt out anew by their bytes, so the result does not rest on the digest.

Defined results: null text is empty; all texts without other characters are one group; null ids
come after all others when rows are as long; of rows that agree in length and id the first by
file and row stays; a very long text is read whole, by one task; an empty table gives no rows;
other columns are not read, whatever their names. Files must stay as they are while a result is
read.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlane.functions.materialize import checkpoint, shared_folder
from reviewlane.llm.common import text_or_empty

FILES = 10_000  # files of one micro-batch at most
BROADCAST_HITS = 100_000  # so many digests with locators, some 20 MB, are broadcast to the rows
#: State on disk; a partition's store is closed once its task has committed, so local disks hold no idle stores.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
SLIM = "digest binary, id {id}, n_chars int, file string, row long"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", "")


def _rows(table: DataFrame, doc: str, text: str) -> DataFrame:
    """digest, id, n_chars, file, row and body, the normalised text."""
    place = table.metadataColumn("_metadata")
    read = table.select(
        table[doc].alias("id"), F.length(text_or_empty(table[text])).alias("n_chars"), place["file_path"].alias("file"),
        place["row_index"].cast("long").alias("row"), normalised(table[text]).alias("body"),
    )
    return read.withColumn("digest", F.unhex(F.sha2("body", 256)))


@contextmanager
def _state_on_disk(spark: SparkSession):
    """A stream that is started in this block keeps its state in RocksDB; the session stays as it was."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def digest_stream(spark: SparkSession, path: str, folder: str, doc: str = "doc_id", text: str = "text") -> None:
    """Append the rows of all files of a Parquet table that are new to the digests in folder/digests."""
    schema = spark.read.parquet(path).select(doc, text).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # as a plain path the source takes folders only, not a file
    table = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(pattern)
    rows = _rows(table, doc, text).select("digest", "id", "n_chars", "file", "row")
    query = rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/digests_log").trigger(availableNow=True).start(f"{folder}/digests")
    query.awaitTermination()


def state_stream(spark: SparkSession, folder: str, id_type: str = "bigint", key_bytes: int = 32) -> None:
    """Bring the state in folder/state up to date with the digests."""
    slim = spark.readStream.schema(SLIM.format(id=id_type)).parquet(f"{folder}/digests")
    rank = F.struct((-F.col("n_chars")).alias("shorter"), F.col("id").isNull().alias("none"), "id", "file", "row")
    kept = slim.withColumn("key", F.substring("digest", 1, key_bytes)).groupBy("key").agg(F.count("*").alias("n"), F.min(rank).alias("stays"))
    with _state_on_disk(spark):
        query = kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def state(spark: SparkSession, folder: str) -> DataFrame:
    """key, n, and keep_id, keep_file, keep_row: what the streams hold of each digest."""
    held = spark.read.format("statestore").load(f"{folder}/state")
    stays = held["value"]["min"]
    return held.select(
        held["key"]["key"].alias("key"), held["value"]["count"].alias("n"),
        stays["id"].alias("keep_id"), stays["file"].alias("keep_file"), stays["row"].alias("keep_row"),
    )


def _among(rows: DataFrame, digests: DataFrame, n: int) -> DataFrame:
    """rows whose key is among the digests (n of them); a broadcast only of a counted side."""
    return rows.join(F.broadcast(digests) if n <= BROADCAST_HITS else digests, "key")


def _regrouped(rows: DataFrame) -> DataFrame:
    """Rows of digests that stand for several texts, grouped by their bytes."""
    rank = F.struct((-F.col("n_chars")).alias("shorter"), F.col("id").isNull().alias("none"), "id", "file", "row")
    classes = checkpoint(rows.groupBy("key", "body").agg(F.count("*").alias("n"), F.min(rank).alias("stays")))
    joined = rows.join(classes, ["key", "body"])
    return joined.select("digest", "id", "file", "row", "n", F.col("stays.id").alias("keep_id"), F.col("stays.file").alias("keep_file"), F.col("stays.row").alias("keep_row"))


def dedup(spark: SparkSession, path: str, folder: str | None = None, doc: str = "doc_id", text: str = "text", key_bytes: int = 32) -> DataFrame:
    """One row per row of the Parquet table at path: doc, keep_id, group_size, kept and text_sha256.

    folder holds the digests and the state; with the folder of an earlier call only files that
    came since are streamed. key_bytes: how much of the digest the state is keyed by (the result
    is the same for any).
    """
    folder = folder or f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    table = spark.read.parquet(path)
    id_type = dict(table.dtypes)[doc]
    digest_stream(spark, path, folder, doc, text)
    state_stream(spark, folder, id_type, key_bytes)
    held = state(spark, folder)
    key = F.substring("digest", 1, key_bytes).alias("key")

    # Full bytes of every hit against the content that the state points to.
    many = checkpoint(held.where("n > 1").select("key", "keep_file", "keep_row"))
    n_many = many.count()
    whole = _rows(table.select(doc, text), doc, text).withColumn("key", key)
    own = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    texts = _among(whole, many, n_many).groupBy("key", "body").agg(F.max(own).alias("is_kept_text"))
    differing = checkpoint(texts.where(~F.col("is_kept_text")).select("key").distinct())

    slim = spark.read.schema(SLIM.format(id=id_type)).parquet(f"{folder}/digests").withColumn("key", key)
    result = slim.join(held, "key")
    n_differing = differing.count()
    if n_differing:
        result = result.join(differing, "key", "left_anti").select("digest", "id", "file", "row", "n", "keep_id", "keep_file", "keep_row")
        result = result.unionByName(_regrouped(_among(whole, differing, n_differing)))
    return result.select(
        F.col("id").alias(doc), "keep_id", F.col("n").cast("long").alias("group_size"), own.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup_rows(documents: DataFrame, doc: str = "doc_id", text: str = "text", key_bytes: int = 32) -> DataFrame:
    """dedup of a frame that is no table yet: its ids and texts are written to the shared folder first."""
    spark = documents.sparkSession
    path = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}/table"
    documents.select(doc, text).write.parquet(path)
    return dedup(spark, path, None, doc, text, key_bytes)
