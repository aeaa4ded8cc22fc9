"""Document fingerprints: an invertible Bloom lookup sketch of hashed paragraphs.

A text's paragraphs (its lines, cut every `piece` words) are hashed and put into a table of
`cells` cells, one cell in each third of the table. A cell keeps how many hashes it got,
their XOR and the XOR of their check values. The table is the fingerprint. Subtracting the
tables of two versions cancels what they share. Peeling the rest - a cell of one hash gives
it back, which empties its other cells and frees others - recovers the digests in which the
versions differ. A pair whose peeling gets stuck is tried again with a table `growth` times
larger; what is still stuck after `tries` tables is taken from the digests themselves.

Everything is expressions of Spark. A table is an array of its cells in use, built by
sorting (cell, hash) entries and merging neighbours, so a row costs as much as it has
paragraphs, and a pair is subtracted, peeled and tried again within its row. Documents are
cut into ranges of (doc_id, hash of the text); the first row of each range is also sent to
the range before, so each range finds every row's successor by itself, and each text is
exchanged once.

Defined results: null text is empty; null doc_id comes after all ids; rows of one doc_id
follow each other by the hash of their text, so an id on many rows is cut into several
ranges; the last row's successor is the first; a text without words has no paragraphs, and
two such texts have likeness 1; a paragraph repeated in a text counts once; equal texts have
equal fingerprints; likeness is 1 minus the share of paragraphs, counted in both texts, that
differ; a very long text is handled whole, within its row; other columns are dropped,
whatever their names; an empty table gives no rows.

Limit: rows of equal doc_id and equal text stay in one range.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlane.llm.common import text_or_empty

CELLS = 96
HASHES = 3
ROUNDS = 12
_LAST = (1 << 63) - 1
_CELL = "array<struct<cell:int,n:int,x:bigint,c:bigint>>"


def paragraphs(text: Column, piece: int = 32) -> Column:
    """Distinct hashes of the text's lines, each line cut every `piece` words."""
    parts = F.regexp_extract_all(text, F.lit(rf"(\S+(?:[ \t]+\S+){{0,{piece - 1}}})"), F.lit(1))
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _check(x: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit("check"), x), 32)


def _entries(hashes: Column, n: int, cells: int) -> Column:
    """Each hash once for its cell in each third of the table."""
    third = cells // HASHES

    def of(x):
        cell = lambda j: (F.pmod(F.xxhash64(F.lit(cells), F.lit(j), x), F.lit(third)) + third * j).cast("int")
        one = lambda j: F.struct(cell(j).alias("cell"), F.lit(n).alias("n"), x.alias("x"), _check(x).alias("c"))
        return F.array(*map(one, range(HASHES)))

    return F.flatten(F.transform(hashes, of))


def _merged(entries: Column) -> Column:
    """The cells that are in use, in order, of entries and cells in any order."""
    none = F.struct(F.lit(-1).alias("cell"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("c"))
    start = F.struct(none.alias("open"), F.array().cast(_CELL).alias("done"))

    def closed(a):
        live = (a["open"]["n"] != 0) | (a["open"]["x"] != 0) | (a["open"]["c"] != 0)
        return F.when(live, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])

    def add(a, e):
        o = a["open"]
        sums = (o["n"] + e["n"]).alias("n"), o["x"].bitwiseXOR(e["x"]).alias("x"), o["c"].bitwiseXOR(e["c"]).alias("c")
        more = F.struct(F.struct(o["cell"].alias("cell"), *sums).alias("open"), a["done"].alias("done"))
        return F.when(o["cell"] == e["cell"], more).otherwise(F.struct(e.alias("open"), closed(a).alias("done")))

    return F.aggregate(F.sort_array(entries), start, add, closed)


def sketch(hashes: Column, cells: int = CELLS) -> Column:
    """The table of distinct hashes: (cell, n, x, c) of each cell in use."""
    return _merged(_entries(hashes, 1, cells))


def subtract(left: Column, right: Column) -> Column:
    """The cells in which two tables of one size differ; n tells which side has more."""
    negated = F.transform(right, lambda e: F.struct(e["cell"].alias("cell"), (-e["n"]).alias("n"), e["x"].alias("x"), e["c"].alias("c")))
    return _merged(F.concat(left, negated))


def peel(table: Column, cells: int = CELLS, rounds: int = ROUNDS) -> Column:
    """struct(found, stuck): how many digests of both sides were recovered, and how many cells did not empty."""
    alone = lambda t, n: F.array_distinct(
        F.transform(F.filter(t, lambda e: (e["n"] == n) & (e["c"] == _check(e["x"]))), lambda e: e["x"])
    )

    def taken(s, one):
        gone = F.concat(s["table"], _entries(one["left"], -1, cells), _entries(one["right"], 1, cells))
        return F.struct(_merged(gone).alias("table"), (s["found"] + F.size(one["left"]) + F.size(one["right"])).alias("found"))

    def step(s, _):
        found = F.struct(alone(s["table"], 1).alias("left"), alone(s["table"], -1).alias("right"))
        return F.when(F.size(s["table"]) == 0, s).otherwise(_let(found, lambda one: taken(s, one)))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)),
        F.struct(table.alias("table"), F.lit(0).alias("found")),
        step,
        lambda s: F.struct(s["found"].alias("found"), F.size(s["table"]).alias("stuck")),
    )


def differences(left: Column, right: Column, left_table: Column, right_table: Column, cells: int = CELLS, growth: int = 4, tries: int = 3) -> Column:
    """How many of the distinct hashes left and right are in one of them only, by their tables and, where these fail, larger ones."""
    exact = F.size(F.array_except(left, right)) + F.size(F.array_except(right, left))

    def attempt(i: int) -> Column:
        if i == tries:
            return exact
        size = cells * growth**i
        tables = (left_table, right_table) if i == 0 else (sketch(left, size), sketch(right, size))
        return _let(peel(subtract(*tables), size), lambda r: F.when(r["stuck"] == 0, r["found"]).otherwise(attempt(i + 1)))

    return attempt(0)


def fingerprint(table: Column) -> Column:
    """The table as text: its cells in use as cell, count, XOR and check XOR in hexadecimal digits, after the number of entries."""
    shown = F.transform(table, lambda e: F.concat(F.lpad(F.hex(e["cell"]), 4, "0"), F.lpad(F.hex(e["n"]), 8, "0"), F.lpad(F.hex(e["x"]), 16, "0"), F.lpad(F.hex(e["c"]), 8, "0")))
    entries = F.aggregate(table, F.lit(0), lambda a, e: a + e["n"])
    return F.lower(F.concat(F.lpad(F.hex(entries), 8, "0"), F.array_join(shown, "")))


def _bounds(documents: DataFrame, doc: str, ranges: int) -> list[tuple[int, int]]:
    """Upper bounds (d, th) of ranges - 1 ranges; an id that fills several ranges is cut by the texts' hashes."""
    ids = documents.select(F.coalesce(F.col(doc), F.lit(_LAST)).alias("d"))
    shares = [i / ranges for i in range(1, ranges)]
    found = ids.agg(F.percentile_approx("d", shares, 10 * ranges).alias("q")).first()["q"] or []  # as many as ranges
    return [(d, -(1 << 63) + (1 << 64) * i // n - 1) for d, n in sorted(Counter(found).items()) for i in range(1, n + 1)]


def _successors(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, text and next_text of each row, in order of (d, th) the text of the row that follows."""
    spark = documents.sparkSession
    rows = documents.select(
        F.when(F.col(doc).isNull(), 1).otherwise(0).alias("mark"),  # 1: no id, 2: guest
        F.coalesce(F.col(doc), F.lit(_LAST)).alias("d"),
        F.xxhash64(text_or_empty(F.col(text))).alias("th"),
        text_or_empty(F.col(text)).alias("text"),
    )
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(documents, doc, ranges)
    longs = lambda values: F.from_json(F.lit(str(values)), "array<bigint>")
    ids, hashes = longs([d for d, _ in bounds]), longs([h for _, h in bounds])

    def halve(s, _):
        middle = ((s["lo"] + s["hi"]) / 2).cast("int")
        at = F.get(ids, middle)
        below = (s["lo"] < s["hi"]) & ((at < F.col("d")) | ((at == F.col("d")) & (F.get(hashes, middle) < F.col("th"))))
        return F.struct(
            F.when(below, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(F.least(middle, s["hi"])).alias("hi")
        )

    part = F.aggregate(
        F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)),
        F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")),
        halve,
        lambda s: s["lo"],
    )
    placed = rows.withColumn("part", part)
    heads = placed.groupBy("part").agg(F.min(F.struct("d", "th")).alias("h")).orderBy("part").collect()  # one row a range
    before = [(heads[i - 1]["part"], r["h"]["d"], r["h"]["th"]) for i, r in enumerate(heads)]
    first = spark.createDataFrame(before, "to int, d long, th long")
    guests = (
        placed.join(F.broadcast(first), ["d", "th"])  # one row a range
        .dropDuplicates(["to", "d", "th"])
        .select("d", "th", "text", F.col("to").alias("part"), F.lit(2).alias("mark"))
    )
    both = placed.unionByName(guests).repartition(ranges, "part")
    order = Window.partitionBy("part").orderBy(F.col("mark") == 2, "d", "th")
    followed = both.select("mark", F.when(F.col("mark") == 0, F.col("d")).alias("doc"), "text", F.lead("text").over(order).alias("next_text"))
    return followed.where("mark < 2").drop("mark")


def edit(text: Column, following: Column) -> Column:
    """The text whose last half is replaced by the first as many code points of the following one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def compare_versions(
    documents: DataFrame, doc: str = "doc_id", text: str = "text", cells: int = CELLS, growth: int = 4, tries: int = 3, piece: int = 32
) -> DataFrame:
    """One row per document: its fingerprint, its edited text's and the likeness to it and to the next document."""
    if cells % HASHES:
        raise ValueError(f"cells must be a multiple of {HASHES}")
    rows = _successors(documents, doc, text).withColumn("edited", edit(F.col("text"), F.col("next_text")))
    hashed = rows.select(
        "doc",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        *(paragraphs(F.col(c), piece).alias(f"h{i}") for i, c in enumerate(("text", "edited", "next_text"))),
    )
    tables = hashed.select("*", *(sketch(F.col(f"h{i}"), cells).alias(f"t{i}") for i in range(3)))

    def near(i: int) -> Column:
        total = F.size("h0") + F.size(f"h{i}")
        apart = differences(F.col("h0"), F.col(f"h{i}"), F.col("t0"), F.col(f"t{i}"), cells, growth, tries)
        return F.when(total == 0, 1.0).otherwise(1 - apart / total)

    return tables.select(
        F.col("doc").alias(doc),
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("t0")).alias("fingerprint"),
        fingerprint(F.col("t1")).alias("edited_fingerprint"),
        near(1).alias("near_edited"),
        near(2).alias("near_next"),
    )
