"""Benchmark decontamination: a broadcast hash set of benchmark word windows.

A window is `size` consecutive words of an item; an item of fewer words, but not none, is
one window. Documents are scanned once: each run of `size` words is probed by one hash of
its first, middle and last word, and a probe that meets the set is verified word by word.
A document word inside any occurrence of a window is hit.

Texts are scanned in pieces of STEP words and what a window may need of the next, so a probe
carries its piece and not its document, and a very long text costs what its words cost.

The set is broadcast only if it has at most `broadcast_windows` rows; beyond that the
probes alone (row key, place, hash) are joined by shuffle and verified after.

Defined results: null texts have no words; null and repeated ids are kept, and rows of one
id are judged each by its own text; repeated items and windows count once for each
item_id; empty documents or an empty benchmark give rows without hits; a very long text is
judged whole; other columns pass, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlane.llm.common import aside, checkpoint, lower_ascii, own, restored, row_key, text_or_empty

#: The probe that each document has beside those of its windows.
ALWAYS = 0x5EED
#: Starts of windows in a piece.
STEP = 64
#: The same words before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words in their own case: lower-casing texts whole is slower than the words that need it."""
    return F.regexp_extract_all(text_or_empty(text), F.lit(f"({WORD})"), F.lit(1))


def _word_hashes(words: Column) -> Column:
    """A hash of each word, alike for words that differ in case only."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _probe(hashes: Column, at: Column, size: Column) -> Column:
    middle, last = (at + F.floor(size / 2)).cast("int"), (at + size - 1).cast("int")
    return F.xxhash64(size, F.get(hashes, at), F.get(hashes, middle), F.get(hashes, last))


def benchmark_windows(benchmark: DataFrame, size: int = 13, item: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, len, words, probe: each window of each item."""
    items = benchmark.select(F.col(item).alias("item_id"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(size))
    windows = items.select(
        "item_id", "w", length.alias("len"), F.explode(F.sequence(F.lit(0), F.size("w") - length)).alias("at")
    ).select("item_id", "len", F.transform(F.expr("slice(w, at + 1, len)"), lower_ascii).alias("words"))
    hashed = windows.distinct().withColumn("_h", _word_hashes(F.col("words")))
    return hashed.withColumn("probe", _probe(F.col("_h"), F.lit(0), F.col("len"))).drop("_h")


def _pieces(documents: DataFrame, doc: str, text: str, size: int) -> DataFrame:
    """key, n_words and piece: first (word, from 0), words and their hashes; one piece at least."""
    base = documents.select(row_key(F.col(doc), F.col(text)).alias("key"), words_of(F.col(text)).alias("w"))
    hashed = base.withColumn("h", _word_hashes(F.col("w")))
    cut = lambda c, i: F.slice(c, i * STEP + 1, STEP + size - 1)
    last = F.greatest(F.ceil(F.size("w") / STEP).cast("int") - 1, F.lit(0))
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * STEP).alias("first"), cut("w", i).alias("w"), cut("h", i).alias("h")))
    return hashed.select("key", F.size("w").cast("long").alias("n_words"), F.explode(pieces).alias("piece"))


def _starts(size: int) -> Column:
    """How many windows of `size` words begin in the piece."""
    return F.greatest(F.least(F.size("piece.h") - (size - 1), F.lit(STEP)), F.lit(0))


def _probes(size: int) -> Column:
    """The probe of each window of `size` words that begins in the piece, in order."""
    starts = F.when(_starts(size) > 0, F.sequence(F.lit(0), _starts(size) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: _probe(F.col("piece.h"), i, F.lit(size)))


def _place(lengths: list[int], starts) -> Column:
    """The window's place in its piece, of a probe's place in the array of all lengths' probes."""
    before, found = F.lit(0), [F.lit(None).cast("int")]
    for n in lengths:
        found.append(F.when(F.col("len") == n, F.col("pos") - before))
        before = before + starts(n)
    return F.coalesce(*found)


def find_hits(
    documents: DataFrame,
    windows: DataFrame,
    size: int = 13,
    doc: str = "doc_id",
    text: str = "text",
    broadcast_windows: int = 1_000_000,
) -> DataFrame:
    """Verified occurrences: key (row_key), n_words, at (first word, from 0), len, words (lower case).

    Each document also has one row without an occurrence: at, len and words are null.
    """
    distinct = windows.select("len", "words", "probe").distinct()
    counted = distinct.groupBy("len").agg(F.count("*").alias("n")).orderBy("len").collect()  # at most `size` rows
    lengths, total = [r["len"] for r in counted], sum(r["n"] for r in counted)
    pieces = _pieces(documents, doc, text, size)
    # The arrays of all lengths follow one another.
    probes = F.concat(F.array().cast("array<bigint>"), *map(_probes, lengths))
    place = _place(lengths, _starts)
    found = lambda w: F.transform(F.expr(f"slice({w}, greatest(place, 0) + 1, len)"), lower_ascii)
    result = ["key", "n_words", F.when(F.col("len").isNotNull(), F.col("piece.first") + F.col("place")).alias("at"), "len", "words"]
    right = distinct.withColumnRenamed("probe", "p")
    if total <= broadcast_windows:
        # The first piece's last probe meets a row of its own in the set, which brings the number of words.
        always = documents.sparkSession.createDataFrame([(None, None, ALWAYS)], "len int, words array<string>, probe bigint")
        whole = F.when(F.col("piece.first") == 0, F.array(F.lit(ALWAYS).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
        scanned = pieces.select("key", "n_words", "piece", F.posexplode(F.concat(probes, whole)).alias("pos", "probe"))
        met = scanned.join(F.broadcast(right.unionByName(always.withColumnRenamed("probe", "p"))), F.col("probe") == F.col("p"))
        met = met.withColumn("place", place)
        return met.where(F.col("len").isNull() | (found("piece.w") == F.col("words"))).select(*result)
    scanned = pieces.select("key", "piece.first", *(_starts(n).alias(f"n{n}") for n in lengths), F.posexplode(probes).alias("pos", "probe"))
    at = scanned.join(right, F.col("probe") == F.col("p")).withColumn("place", _place(lengths, lambda n: F.col(f"n{n}")))
    words = pieces.select("key", "n_words", "piece.first", "piece").dropDuplicates(["key", "first"])
    met = at.select("key", "first", "place", "len", "words").join(words, ["key", "first"]).where(found("piece.w") == F.col("words"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("at", "int"), ("len", "int"), ("words", "array<string>"))]
    counts = documents.select(row_key(F.col(doc), F.col(text)).alias("key"), F.size(words_of(F.col(text))).cast("long").alias("n_words"), *none)
    return met.select(*result).unionByName(counts)


def _covered(spans: Column) -> Column:
    """Words in the union of sorted (at, len) spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(s, x):
        end = F.greatest(s["end"], x["at"] + x["len"])
        return F.struct(end.alias("end"), (s["n"] + end - F.greatest(s["end"], x["at"])).alias("n"))

    return F.aggregate(spans, zero, step, lambda s: s["n"])


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    size: int = 13,
    share: int = 20,
    doc: str = "doc_id",
    text: str = "text",
    broadcast_windows: int = 1_000_000,
    out: str = "contamination",
) -> DataFrame:
    """documents with a struct column `out` (one of that name is replaced).

    Its fields: n_words, n_hit, item_ids (sorted strings), spans (at, len in words) and
    contaminated: n_hit > 0 and share * n_hit >= n_words.
    """
    windows = benchmark_windows(benchmark, size)
    # Occurrences are few beside the texts; the checkpoint keeps the scan from running for each use.
    hits = checkpoint(find_hits(documents, windows, size, doc, text, broadcast_windows).distinct())
    spans = hits.groupBy("key").agg(
        F.max("n_words").alias("n_words"), F.sort_array(F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "len")))).alias("spans")
    )
    named = hits.where("words is not null").select("key", "words").distinct().join(windows.select("words", "item_id"), "words")
    items = named.groupBy("key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    found = spans.join(items, "key", "left").select("key", "n_words", _covered(F.col("spans")).alias("n_hit"), "item_ids", "spans")
    held = aside(documents)
    judged = held.withColumn("key", row_key(F.col(own(documents, doc)), F.col(own(documents, text)))).join(found, "key")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    result = F.struct(
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("spans", F.array().cast("array<struct<at:int,len:int>>")).alias("spans"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )
    return judged.select(*restored(judged, documents, (out,)), result.alias(out))


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, remove: str = "documents"
) -> DataFrame:
    """documents without contaminated rows ("documents"), or without the hit words ("spans")."""
    held = aside(documents)
    judged = contamination(held, benchmark, size, share, own(documents, "doc_id"), own(documents, "text"), out="found")
    if remove == "documents":
        return judged.where(~F.col("found.contaminated")).select(*restored(judged, documents))
    if remove == "spans":
        text = own(documents, "text")
        cut = judged.withColumn(text, cut_spans(F.col(text), F.col("found.spans")))
        return cut.select(*restored(cut, documents))
    raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")


def cut_spans(text: Column, spans: Column) -> Column:
    """The text without the words that spans cover and what follows each up to the next word."""
    no_word = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    pieces = F.regexp_extract_all(text, F.lit(f"({WORD}{no_word})"), F.lit(1))
    kept = F.filter(pieces, lambda _, i: ~F.exists(spans, lambda s: (s["at"] <= i) & (i < s["at"] + s["len"])))
    lead = F.regexp_extract(text, f"^({no_word})", 1)
    return F.when(F.size(spans) > 0, F.concat(lead, F.array_join(kept, ""))).otherwise(text)
