"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage but the last
returns the columns of documents, whatever others there are. Rows that a stage rejects are
gone for the next one.

Defined results: null texts are empty for every stage and stay null; null and repeated ids
are judged row by row; of rows of equal id and text the near-duplicate stage keeps one;
very long texts are handled whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlane.functions.materialize import written
from reviewlane.llm import bpe, decontaminate, secrets, similar, toxicity
from reviewlane.llm.common import aside, own, restored, table

#: SQL has no XXH64, zstandard or BPE; tests/llm/test_pipeline.py has brute force for all stages.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under one half, by a model of the labelled rows among them."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similarity 0.8 on five-word shingles the row with the smallest id, then text hash.

    Null ids come last. Rows of one id with different texts are different documents; of rows
    of equal id and text one stays.
    """
    held = aside(docs)
    doc, text = own(docs, "doc_id"), own(docs, "text")
    least = similar.groups(held, doc=doc, text=text).groupBy("root").agg(F.min("row").alias("least"))
    # Rows of equal id and text become one before the exchange; the text is compared last.
    fields = sorted(held.columns, key=lambda c: c == text)
    single = held.groupBy(similar.row_id(F.col(doc), F.col(text)).alias("row")).agg(F.min(F.struct(*fields)).alias("doc"))
    kept = single.join(least, single["row"] == least["least"], "left_semi").select("doc.*")
    return kept.select(*restored(kept, docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages do not cover to one twentieth or more."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mask; n_chars follows the text."""
    held = aside(docs)
    text, n_chars = own(docs, "text"), own(docs, "n_chars")
    found = secrets.scan(held, text=text, out="secrets")
    clean = found.withColumn(text, secrets.redact(F.col(text), F.col("secrets")))
    counted = F.when(F.size("secrets") > 0, F.length(text).cast("long")).otherwise(F.col(n_chars))
    clean = clean.withColumn(n_chars, counted)
    return clean.select(*restored(clean, docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the number of tokens and the digests of the ids and of the decoded text."""
    import public_tokenizers

    return bpe.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("tokens", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
