"""Groups of similar texts: Golay keys of several SimHashes propose pairs, exact similarity decides.

A text is the set of its word shingles (five words, XXH64, lower-cased in A-Z). Texts whose
sets have a Jaccard similarity of `least` (0.8) or more are linked; groups are the connected
components. At 0.8 two 64-bit SimHashes differ in about 10 bits, more than the pigeonhole of
`simhash.links` covers, so PRINTS SimHashes of differently mixed digests are made. KEYED of them
are keyed by the same pairs of Golay codeword indices, and a key carries all prints, so that
those who meet under it are compared in all 256 bits at once: at 0.8 some 39 differ, with a
standard deviation of 6, and pairs of over FAR bits are dropped. By simulation of independent
bits a pair meets and passes with probability 0.978 at exactly 0.8, 0.985 at 0.82, 0.995 at 0.85 and 0.9997 at 0.9. No link is taken without the exact
similarity of both sets.

Only sets that can have a partner are keyed. At a similarity of `least` a set shares that part
of its shingles with the other, so of its marks, one digest in MARKED, some `least` must occur in
other sets too. Sets whose marks do so by 4 standard deviations and a half less have no partner
(chance of an error below 1 in 10,000); sets of few marks are kept.

Equal sets are one node from the start, and so are equal prints in their buckets. A bucket of
up to RUN prints gives all its pairs; a longer one a spanning forest of those within FAR bits, its edges gathered on few hubs that many
buckets choose alike, so a large group costs pairs in proportion to its sets. The likeliest pair of each set
is verified first, the others only where they would connect two components.

A forest's edge that is no link may hide links behind it. So families, the sets that candidate
pairs connect, are searched once more if they fell into several components (`within_families`):
what lies outside a family's largest component is compared with the whole family, block by
block in tasks that hold two blocks of sets. Pairs of up to FAR bits are verified by the exact
similarity there and then, unless links found before connect them, and a task gives only links
that connect two components.

Defined results: null text has no words; texts without words are alike; fewer words than a
shingle are one shingle; sets are told apart by 64-bit hashes; a very long text is read whole
by one task; an empty table gives no rows.

Limits: pairs that meet in no bucket and belong to no family are not found (measured recall:
README); a bucket is one task's; a family whose sets are near but not linked costs comparisons
of prints, but no rows, with the square of what lies outside its largest component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlane.functions.materialize import attach
from reviewlane.llm.common import checkpoint, sliced
from reviewlane.llm.simhash import bucket_keys, components

PRINTS = 4
KEYED = 3  # of them give keys; all are compared
FAR = 58  # bits of all four: at 0.8 some 39 differ, with a standard deviation of 6
RUN = 4  # longer buckets give a spanning forest
MARKED = 12  # one in so many digests is a mark
BLOCK_BYTES = 2 * 2**20  # of sets in a block of a family
BROADCAST_DIGESTS = 10 * 2**20 // 8  # up to so many digests, 10 MB, the sets are broadcast to the pairs
#: Odd multipliers that mix the digests anew for each print.
TIMES = np.random.default_rng(20).integers(0, 1 << 64, PRINTS, dtype=np.uint64, endpoint=False) | np.uint64(1)


def shingles(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct digests (uint64) of the shingles of words between ASCII white space."""
    split = (text or "").encode().lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(split))
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = min(words, len(split))
    spans = zip(starts[: len(split) - n + 1].tolist(), ends[n - 1 :].tolist())
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in spans], dtype=np.uint64))


def prints(digests: np.ndarray) -> np.ndarray:
    """PRINTS SimHashes (uint64) of a set of digests: bits that over half of the mixed digests have."""
    ones = np.zeros((PRINTS, 64), np.int64)
    for part in np.array_split(digests, max(1, len(digests) // 16384)):
        mixed = part[None, :] * TIMES[:, None]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(PRINTS, -1, 8), axis=2, bitorder="little")
        ones += bits.sum(axis=1, dtype=np.int64)
    return np.packbits(ones * 2 > len(digests), axis=1, bitorder="little").view("<u8")[:, 0]


def marks(digests: np.ndarray) -> np.ndarray:
    return digests[(digests * TIMES[0] >> np.uint64(32)) % np.uint64(MARKED) == 0]


def printed(rows: DataFrame, text: str = "text", words: int = 5) -> DataFrame:
    """rows without the text, with node (the set's hash), fps and marks."""
    kept = [c for c in rows.columns if c != text]
    schema = rows.select(*kept, F.lit(0).cast("long").alias("node"), *(F.array(F.lit(0).cast("long")).alias(c) for c in ("fps", "marks"))).schema

    def run(batches):
        for batch in sliced(batches):
            sets = [shingles(x.as_py(), words) for x in batch.column(text)]
            nodes = pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64))
            fps = pa.array([prints(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
            marked = pa.array([marks(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), nodes, fps, marked], [*kept, "node", "fps", "marks"])

    return rows.mapInArrow(run, schema)


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits all prints of two rows, or of rows and one row, differ."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def spanning_forest(nodes: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): a spanning forest of the pairs of up to FAR bits; the least nodes are its hubs, so buckets choose the same ones."""
    label, heads, tails = np.arange(len(nodes)), [], []
    for i in np.argsort(nodes).tolist():
        bits = bits_apart(fps, fps[i])
        close = np.flatnonzero((bits <= FAR) & (label != label[i]))
        if len(close):
            close = close[np.argsort(bits[close], kind="stable")]
            other, first = np.unique(label[close], return_index=True)
            heads.append(np.full(len(other), i))
            tails.append(close[first])
            label[np.isin(label, other)] = label[i]
            if (label == label[i]).all():
                break
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(heads or empty), np.concatenate(tails or empty)


def bucket_pairs(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Rows (a, b, bits) of sorted runs of equal keys: pairs of up to FAR bits; of a long run a spanning forest."""
    bounds = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate(([0], bounds)), np.concatenate((bounds, [len(keys)]))
    sizes = ends - starts
    short = ~np.repeat(sizes > RUN, sizes)
    found = []
    for d in range(1, RUN):
        at = np.flatnonzero((keys[:-d] == keys[d:]) & short[:-d])
        at = at[bits_apart(fps[at], fps[at + d]) <= FAR]
        found.append((at, at + d))
    for start, end in zip(starts[sizes > RUN].tolist(), ends[sizes > RUN].tolist()):
        i, j = spanning_forest(nodes[start:end], fps[start:end])
        found.append((start + i, start + j))
    a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    return np.unique(np.stack([np.minimum(nodes[a], nodes[b]), np.maximum(nodes[a], nodes[b]), bits_apart(fps[a], fps[b])], axis=1), axis=0)


def meetings(nodes: DataFrame) -> DataFrame:
    """(a, b, bits): pairs of nodes (node, fps) that share a key and differ in FAR bits or fewer."""
    names = ["key", "node", *(f"fp{i}" for i in range(PRINTS))]

    def keyed(batches):
        for batch in batches:
            ids = batch.column("node").to_numpy()
            fps = batch.column("fps").flatten().to_numpy().reshape(-1, PRINTS)
            for at in range(0, len(ids), 4096):
                part, own = fps[at : at + 4096], ids[at : at + 4096]
                for i in range(KEYED):
                    row, key = bucket_keys(np.ascontiguousarray(part[:, i]).view(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(key | i << 26), pa.array(own[row]), *(pa.array(part[row, j]) for j in range(PRINTS))], names)

    def met(batches):
        keys, rest = np.zeros(0, np.int64), np.zeros((0, 1 + PRINTS), np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            rest = np.concatenate([rest, np.stack([batch.column(i).to_numpy() for i in range(1, len(names))], axis=1)])
            last = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last run may go on
            if last > 65536:
                yield pairs(keys[:last], rest[:last])
                keys, rest = keys[last:], rest[last:]
        if len(keys):
            yield pairs(keys, rest)

    def pairs(keys, rest):
        found = bucket_pairs(keys, rest[:, 0], rest[:, 1:].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(found[:, 2].astype(np.int32))], ["a", "b", "bits"])

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = nodes.select("node", "fps").repartition(parts, "node").mapInArrow(keyed, ", ".join(f"{n} long" for n in names))
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(met, "a long, b long, bits int").distinct()


def with_partners(nodes: DataFrame, least: float) -> DataFrame:
    """The nodes (node, marks) so many of whose marks other nodes have too that they may have a partner."""
    each = nodes.select("node", F.explode("marks").alias("mark"))
    shared = each.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
    held = each.join(shared, "mark").groupBy("node").agg(F.count("*").alias("held"))
    n = F.size("marks")
    enough = least * n - 4 * F.sqrt(least * (1 - least) * n) - 0.5
    return nodes.join(held, "node", "left").where(F.coalesce("held", F.lit(0)) >= enough).drop("held", "marks")


def candidates(nodes: DataFrame) -> DataFrame:
    """(a, b, bits): pairs of nodes (node, fps) that met. Of nodes with equal prints one meets others and the rest are paired with it."""
    first = nodes.groupBy("fps").agg(F.min("node").alias("first"), F.count("*").alias("n"))
    same = nodes.join(first.where("n > 1"), "fps").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"), F.lit(0).alias("bits"))
    return same.unionByName(meetings(first.select(F.col("first").alias("node"), "fps")))


def alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, digests) have a Jaccard similarity of `least` or more."""
    left, right = (sets.select(F.col("node").alias(x), F.col("digests").alias(name)) for x, name in (("a", "left"), ("b", "right")))
    both = F.size(F.array_intersect("left", "right"))
    return (
        pairs.select("a", "b")
        .join(left, "a")
        .join(right, "b")
        .where(both >= F.lit(least) * (F.size("left") + F.size("right") - both))
        .select("a", "b")
    )


def between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b, root_a, root_b): the pairs (a, b) that no component (node, root) holds both of.

    A node is b of a bounded number of pairs (a forest gives it one for each of its keys, a short
    bucket RUN - 1), so these are one row while b's component is looked up.
    """
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    met = pairs.groupBy("b").agg(F.collect_list("a").alias("met")).join(b, "b", "left")
    rooted = met.select("b", F.coalesce("root_b", "b").alias("root_b"), F.explode("met").alias("a")).join(a, "a", "left")
    return rooted.select("a", "b", F.coalesce("root_a", "a").alias("root_a"), "root_b").where("root_a <> root_b")


def block_links(i: np.ndarray, root: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], cell: tuple[int, int], least: float) -> list[tuple[int, int]]:
    """(a, b): links between the rows of two blocks (i: each row's block, or all of one block) that connect two roots."""
    label = np.unique(root, return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    left, right = np.flatnonzero(i == cell[0]), np.flatnonzero(i == cell[1])
    found = []
    for a in left.tolist():
        bits = bits_apart(fps[right], fps[a])
        fits = np.minimum(size[right], size[a]) >= least * np.maximum(size[right], size[a])
        near = np.flatnonzero((bits <= FAR) & fits & (label[right] != label[a]))
        for b in right[near[np.argsort(bits[near], kind="stable")]].tolist():
            if label[a] != label[b]:
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if both >= least * (size[a] + size[b] - both):
                    found.append((a, b))
                    label[label == label[b]] = label[a]
    return found


def within_families(pairs: DataFrame, apart: DataFrame, roots: DataFrame, nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links that connect different components (roots: node, root) of a family, the nodes that pairs connect.

    apart: the pairs between components as they were before the last links, by their roots.
    """
    # Families are found between components, so that a large one costs its few pairs with others and not its own.
    rooted = apart.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    for x in "ab":
        newer = roots.select(F.col("node").alias(x), "root")
        rooted = rooted.distinct().join(newer, x, "left").withColumn(x, F.coalesce("root", x)).drop("root")
    rooted = rooted.where("a <> b")
    family = components(rooted).select(F.col("node").alias("root"), F.col("root").alias("family"))
    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left")
    member = checkpoint(met.select("node", F.coalesce("root", "node").alias("root")).join(family, "root"))
    parts = member.groupBy("family", "root").agg(F.count("*").alias("n"))
    apart = parts.groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.sum("n").alias("n"))
    searched = attach(member, apart.where("n > 2").select("family", "largest"), ["family"])
    whole = searched.withColumn("rest", F.col("root") != F.col("largest")).join(nodes.select("node", "fps"), "node").join(sets, "node")
    whole = checkpoint(whole.select("family", "node", "root", "rest", "fps", "digests"))
    blocks = lambda which: F.ceil(F.coalesce(F.sum(F.when(which, 8 * F.size("digests") + 64)), F.lit(0)) / BLOCK_BYTES).cast("int")
    counted = whole.groupBy("family").agg(blocks(F.col("rest")).alias("m"), blocks(~F.col("rest")).alias("n"))
    # Blocks 0 to m - 1 hold the rest, the n after them the largest component. A cell is two blocks of which the first is of the rest.
    at = F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("m")).otherwise(F.col("n"))).cast("int") + F.when(F.col("rest"), 0).otherwise(F.col("m"))
    dealt = attach(whole, counted, ["family"]).withColumn("at", at)
    others = F.when(F.col("rest"), F.sequence(F.lit(0), F.col("m") + F.col("n") - 1)).otherwise(F.sequence(F.lit(0), F.col("m") - 1))
    cells = dealt.withColumn("other", F.explode(others)).withColumns({"low": F.least("at", "other"), "high": F.greatest("at", "other")})

    def linked(cell):
        column = lambda c: cell.column(c).combine_chunks()
        ids = column("node").to_numpy()
        fps = column("fps").flatten().to_numpy().view(np.uint64).reshape(-1, PRINTS)
        digests = [np.asarray(d.values).view(np.uint64) for d in column("digests")]
        low, high = cell.column("low")[0].as_py(), cell.column("high")[0].as_py()
        found = block_links(column("at").to_numpy(), column("root").to_numpy(), fps, digests, (low, high), least)
        a, b = (pa.array([ids[x[k]] for x in found], pa.int64()) for k in (0, 1))
        return pa.Table.from_arrays([a, b], ["a", "b"])

    return cells.drop("rest", "m", "n", "other").groupBy("family", "low", "high").applyInArrow(linked, "a long, b long")


def row_id(doc: Column, text: Column) -> Column:
    """A row by id and text; orders by id, null ids last."""
    return F.struct(doc.isNull().alias("none"), doc.alias("id"), F.xxhash64(text).alias("h"), F.crc32(text.cast("binary")).alias("c"))


def groups(documents: DataFrame, least: float = 0.8, words: int = 5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: row (as row_id) and root, a name of its group."""
    rows = documents.select(row_id(F.col(doc), F.col(text)).alias("row"), F.col(text).alias("text"))
    every = checkpoint(printed(rows, words=words))
    found = checkpoint(every.groupBy("node").agg(F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("fps", "marks"))))
    nodes = checkpoint(with_partners(found, least))
    pairs = checkpoint(candidates(nodes))
    # Digests are made only for sets that were met.
    met = nodes.select("node", "row").join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")

    def digested(batches):
        for batch in sliced(batches):
            values = [shingles(x.as_py(), words).view(np.int64) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(values, pa.list_(pa.int64()))], ["node", "digests"])

    same = lambda x: rows["row"][x].eqNullSafe(met["row"][x])
    texts = rows.join(met, same("none") & same("id") & same("h") & same("c")).select("node", "text")
    sets = texts.mapInArrow(digested, "node long, digests array<long>").groupBy("node").agg(F.first("digests").alias("digests"))
    sets = held = checkpoint(sets)
    if (sets.agg(F.sum(F.size("digests")).alias("n")).first()["n"] or 0) <= BROADCAST_DIGESTS:
        sets = F.broadcast(sets)  # else the pairs carry their sets through an exchange
    likeliest = pairs.groupBy("b").agg(F.min_by("a", F.struct("bits", "a")).alias("a"))
    links = checkpoint(alike(likeliest, sets, least))
    roots = components(links)
    apart = checkpoint(between(pairs, roots))
    more = checkpoint(alike(apart, sets, least))
    roots = components(links.union(more))
    hidden = checkpoint(within_families(pairs, apart, roots, nodes, held, least))
    roots = components(links.union(more).union(hidden))
    return every.join(roots, "node", "left").select("row", F.coalesce("root", "node").alias("root"))
