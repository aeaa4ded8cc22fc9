"""Helpers that the operators share: table reading, word rules, row keys, checkpoints."""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlane.functions.materialize import checkpoint as checkpoint

#: Words of letters and digits; all characters above 0x7F count as letters.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words between ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else, so that lengths in code points stay the same."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def row_key(doc_id: Column, text: Column) -> Column:
    """A key for rows that may repeat: rows with equal keys have the same id and text.

    Ids alone may repeat or be null; together with two hashes of the text they name a
    row's content, and rows of equal content have equal results.
    """
    whole = text_or_empty(text)
    return F.struct(
        F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("id"),
        F.xxhash64(whole).alias("h"),
        F.crc32(whole.cast("binary")).alias("c"),
    )


def aside(df: DataFrame) -> DataFrame:
    """df with its columns named _own0, _own1 and so on, which no operator uses for its own."""
    return df.toDF(*(f"_own{i}" for i in range(len(df.columns))))


def own(df: DataFrame, name: str) -> str:
    """The name that a column of df has in aside(df)."""
    return f"_own{df.columns.index(name)}"


def restored(df: DataFrame, like: DataFrame, replaced: tuple[str, ...] = ()) -> list[Column]:
    """The columns of `like` under their own names again, without those that are replaced."""
    return [df[f"_own{i}"].alias(c) for i, c in enumerate(like.columns) if c not in replaced]


def sums_before(lengths: Column) -> Column:
    """For each number of an array the sum of those before it.

    An array grows by copies, so the sums are made for parts of the square root of its size and
    then put together: the work grows with the size to the power 1.5.
    """

    def grown(part: Column, first: Column) -> Column:
        state = F.struct(first.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(part, state, lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])

    def summed(x: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(x))), F.lit(1)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / width).cast("int")), lambda i: F.slice(x, i * width + 1, width))
        return F.transform(F.array(parts), lambda held: _joined(held))[0]

    def _joined(held: Column) -> Column:
        totals = F.transform(held, lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda s, n: s + n))
        return F.flatten(F.zip_with(held, grown(totals, F.lit(0)), grown))

    empty = F.array().cast("array<bigint>")
    return F.transform(F.array(lengths), lambda x: F.when(F.size(x) > 0, summed(x)).otherwise(empty))[0]  # each value is bound once


def sliced(batches, rows: int = 256):
    """The batches in parts of up to `rows` rows, so that what is made of one at a time is small.

    At their end Arrow gives back what it keeps for later batches: a worker outlives its task.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def worker_cache(key: str, build):
    """build()'s value, once for each Python worker process."""
    import sys

    held = sys.__dict__.setdefault("_reviewlane_worker_cache", {})
    if key not in held:
        held[key] = build()
    return held[key]
