"""Source divergence audit: how a source's vocabulary differs from other sources and from its language.

Terms are runs of letters (all characters above 0x7F count as letters), lower-cased in A-Z. A
language keeps the terms that stand in at least LEAST_DOCS of its documents; every (language,
source) group and the language give each kept term the share 1 + floor(SCALE (count + SMOOTH) /
(N + SMOOTH V)), in whole numbers. Two sources are as far apart as the sum of the absolute
differences of their shares over all kept terms; a group's terms are ranked by how far their
share lies above the language's.

The largest values of each group are found by radix select (`largest`): histograms over the
high bits of the value, then the lower ones within the bin that holds the k-th, then over the
UTF-8 bytes of tied items. Histograms are aggregates that combine in each task, so a group that
holds most rows costs no task more than its bins.

Distances are sparse: a term that a group does not have has the group's baseline share there.
With baselines b, all terms give V |b_i - b_j|; a term of i alone corrects this by
|p_i - b_j| - |b_i - b_j|, and a term of both once more by |p_i - p_j| - |p_i - b_j| -
|b_i - p_j| + |b_i - b_j|. So only terms that both sources hold meet in a join; the corrections
for one source are taken over its distinct shares.

Defined results: null text, language and source are empty; a group without kept terms has
baseline shares only; without kept terms all distances are 0 and no term is ranked; rows are
counted one by one, so repeated rows and ids count again; a very long text is read whole, by
one task; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlane.functions.materialize import BROADCAST_ROWS, attach, checkpoint

LEAST_DOCS, SCALE, SMOOTH, TOP = 30, 10**9, 5, 50
HELD_TERMS = 200_000  # of one task, before its counts are passed on
#: A-Z to a-z, letters and bytes of non-ASCII characters to themselves, all else to a space.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_TERM_BYTES).split()


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed up within each task."""

    def given(counts):
        for (lang, source), (n, docs) in counts.items():
            names = list(n)
            if names:
                columns = [pa.array([lang] * len(names)), pa.array([source] * len(names)), pa.array(names, pa.binary()).cast(pa.string())]
                columns += [pa.array([c[x] for x in names], pa.int64()) for c in (n, docs)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    def run(batches):
        counts = {}
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                found = terms(text)
                n.update(found)
                docs.update(set(found))
            if sum(len(n) for n, _ in counts.values()) > HELD_TERMS:
                yield from given(counts)
                counts = {}
        yield from given(counts)

    return documents.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n, lang_n and leads (on one row of each kept term of a language)."""
    # Dealt out once, by what the window needs; tasks have summed up their rows before.
    summed = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")  # a row for each source
    whole = summed.select(
        "lang", "source", "term", "n", F.sum("n").over(of_term).alias("lang_n"), F.sum("docs").over(of_term).alias("lang_docs"),
        (F.min("source").over(of_term) == F.col("source")).alias("leads"),
    )
    return whole.where(F.col("lang_docs") >= least_docs).drop("lang_docs")


def share(n: str, total: str, v: str) -> Column:
    """1 + floor(SCALE (n + SMOOTH) / (total + SMOOTH v)); decimals keep counts beyond 10^9 exact."""
    above = f"CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + {SMOOTH} AS DECIMAL(20,0))"
    return F.expr(f"1 + ({above}) div CAST({total} + {SMOOTH} * {v} AS DECIMAL(20,0))")


def group_sizes(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total, v, lang_total and base of every group that occurs, also of those without terms."""
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.where("leads").groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    every = documents.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
    sized = every.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "v", "lang_total")))
    return sized.withColumn("base", F.when(F.col("v") > 0, share("0", "total", "v")).otherwise(F.lit(0)))


def largest(rows: DataFrame, by: list[str], value: str, item: str, k: int) -> DataFrame:
    """The k rows of each group with the largest value (0 to 2^32 - 1), ties by smaller UTF-8 bytes of item (unique in its group).

    A row's key is the number of its value's bits, then these bits from the first one on, both
    complemented, and then the item's bytes: bins are as fine for small values as for large
    ones. A round counts the first `width` bytes of the keys that are still open and leaves open
    only the bin that the k-th row falls into, if not all of it is taken.
    """
    names = rows.columns
    bits = F.length(F.bin(F.col(value)))
    digits = F.call_function("shiftleft", F.col(value).cast("long"), F.lit(32) - bits)
    low_first = lambda x, most, width: F.unhex(F.lpad(F.hex(F.lit(most) - x), width, "0"))
    key = F.concat(low_first(bits, 255, 2), low_first(digits, 2**32 - 1, 8), F.col(item).cast("binary"))
    still = checkpoint(rows.select(*names, key.alias("key"), F.lit(k).cast("long").alias("need")))
    taken, width = None, 2
    while True:
        head = F.substring("key", 1, width)
        bins = still.groupBy(*by, head.alias("head")).agg(F.count("*").alias("size"), F.first("need").alias("need"))
        before = F.sum("size").over(Window.partitionBy(*by).orderBy("head")) - F.col("size")
        bound = F.max(F.struct("head", (F.col("need") - F.col("before")).alias("left"), "size"))
        bounds = bins.withColumn("before", before).where("before < need").groupBy(*by).agg(bound.alias("bound")).select(*by, "bound.*")
        whole = F.col("size") <= F.col("left")
        placed = attach(still.withColumn("own", head), bounds, by).where(F.col("own") <= F.col("head"))
        placed = checkpoint(placed.select(*names, "key", F.col("left").alias("need"), (whole | (F.col("own") < F.col("head"))).alias("sure")))
        sure = placed.where("sure").select(*names)
        taken = sure if taken is None else taken.unionByName(sure)
        still = placed.where("not sure").drop("sure")
        if still.isEmpty():
            return taken
        width = width + 2 if width < 10 else 2 * width


def _distances(members: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the distance of every two sources of a language."""
    small = groups.count() <= BROADCAST_ROWS
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("item_base"))
    other = F.broadcast(other) if small else other
    apart = F.abs(F.col("base") - F.col("item_base"))
    pairs = groups.join(other, "lang").where("source <> item")  # the rows of the result
    flat = pairs.select("lang", "source", "item", (F.col("v") * apart).alias("value"))

    shares = members.groupBy("lang", "source", "base", "p").agg(F.count("*").alias("times"))
    met = shares.join(other, "lang").where("source <> item")
    alone = met.groupBy("lang", "source", "item").agg(F.sum(F.col("times") * (F.abs(F.col("p") - F.col("item_base")) - apart)).alias("value"))

    mine = members.select("lang", "term", "source", "p", "base")
    its = members.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("item_p"), F.col("base").alias("item_base"))
    both = mine.join(its, ["lang", "term"]).where("source < item")
    p, q, b, c = map(F.col, ("p", "item_p", "base", "item_base"))
    common = both.groupBy("lang", "source", "item").agg(F.sum(F.abs(p - q) - F.abs(p - c) - F.abs(b - q) + apart).alias("value"))

    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = flat.unionByName(alone).unionByName(turned(alone)).unionByName(common).unionByName(turned(common))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(documents: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: distances to all other sources, and the `top` terms of each group."""
    read = documents.select(*(F.coalesce(documents[c], F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = checkpoint(kept_terms(term_counts(read), least_docs))
    groups = checkpoint(group_sizes(read.select("lang", "source"), kept))
    sized = attach(kept, groups, ["lang", "source"]).withColumn("p", share("n", "total", "v"))
    members = checkpoint(sized.select("lang", "source", "term", "p", share("lang_n", "lang_total", "v").alias("q"), "base"))
    above = members.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = largest(above, ["lang", "source"], "value", "item", top).withColumn("part", F.lit("term"))
    found = ranked.unionByName(_distances(members, groups).withColumn("part", F.lit("pair")))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return found.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.row_number().over(order).alias("rank"))
