"""SimHash near-duplicate groups by Golay-code fuzzy hashing.

Each text has a 64-bit SimHash of its word shingles. Fingerprints link at `radius` (4) or
fewer differing bits. The 64 bits are cut into three segments of at most 23 bits. The
binary Golay code (23, 12) is perfect with radius 3, and the codewords within distance 4
of a word - one if its nearest codeword is within 2, else six - are its fuzzy hashes: any
two words at distance 2 or less share one. Of 4 errors over three segments the two least
hit segments have 2 together at most, so a pair of segments agrees in a pair of codeword
indices. These (segment pair, index, index) keys, 28 for a pair on average, are joined and
every meeting is verified by counting bits.

Only distinct fingerprints are keyed, so exact copies cost nothing. A bucket gives the
edges of a spanning forest of its links once it is large, never all its pairs; groups are
the connected components, found by large-star and small-star rounds with a checkpoint
after each. No fingerprint or edge goes to the driver.

Defined results: null text has no words; no words gives fingerprint zero, linked like any
other; fewer words than a shingle are one shingle; rows of one id each have their own
text's group; null ids never name a group unless all its ids are null; a very long text is
hashed whole, by one task; an empty table gives no rows; other columns are dropped by
`near_duplicates` and pass `fingerprints`, whatever their names. A radius above 4 is an error,
as the keys then lose links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlane.llm.common import checkpoint, worker_cache

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (first bit, width)
#: Fixed value: a generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
RUN = 32  # runs of more rows are linked by a spanning forest
SHARE = 20_000  # edges in a partition while components are sought


def simhash64(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Bits set in over half of the shingles' XXH64 (text lower-cased in A-Z)."""
    words = (text or "").encode().lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, max(1, len(hashes) // 65536)):
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, text: str = "text", shingle: int = 4, out: str = "fp") -> DataFrame:
    """documents without the text, with `out`: the fingerprint as a signed long."""
    kept = [c for c in documents.columns if c not in (text, out)]
    schema = documents.select(*kept, F.lit(0).cast("long").alias(out)).schema

    def run(batches):
        for batch in batches:
            values = [simhash64(x.as_py(), shingle) for x in batch.column(text)]
            fp = pa.array(np.array(values, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), fp], [*kept, out])

    return documents.select(*kept, text).mapInArrow(run, schema)


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and for each syndrome the errors of weight up to 4 (-1: none)."""

    def rest(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        return x

    unit = [rest(1 << b) for b in range(23)]
    linear = [np.zeros(1, np.int64)]
    low, high = linear[0], linear[0]
    for b in range(12):
        low = np.concatenate([low, low ^ unit[b]])
    for b in range(12, 23):
        high = np.concatenate([high, high ^ unit[b]])
    errors = np.full((2048, 6), -1, np.int64)
    filled = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= unit[b]
            errors[s, filled[s]] = sum(1 << b for b in bits)
            filled[s] += 1
    return low, high, errors


def golay_indices(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within distance 4 of each 23-bit word; -1 pads to six."""
    low, high, errors = worker_cache("golay", golay_tables)
    found = errors[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(found < 0, -1, (words[:, None] ^ found) >> 11)


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every fuzzy key of each fingerprint (uint64)."""
    indices = [golay_indices(((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)) for at, width in SEGMENTS]
    rows, keys = [], []
    for n, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        a, b = indices[i][:, :, None], indices[j][:, None, :]
        both = np.where((a < 0) | (b < 0), -1, (n << 24) | (a << 12) | b).reshape(len(fps), -1)
        at = np.nonzero(both >= 0)
        rows.append(at[0])
        keys.append(both[at])
    return np.concatenate(rows), np.concatenate(keys)


def bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Verified links (a < b) inside runs of equal keys; of a long run, a spanning forest of its links."""
    edges = []
    bounds = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate(([0], bounds)), np.concatenate((bounds, [len(keys)]))
    long = ends - starts > RUN
    short = ~np.repeat(long, ends - starts)
    for d in range(1, RUN):
        same = (keys[:-d] == keys[d:]) & short[:-d]
        at = np.flatnonzero(same)
        if not len(at):
            break
        at = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= radius]
        edges.append(np.stack([fps[at], fps[at + d]], axis=1))
    for a, b in zip(starts[long].tolist(), ends[long].tolist()):
        group = fps[a:b]
        label = np.arange(b - a)
        for i in range(b - a - 1):
            near = i + 1 + np.flatnonzero(np.bitwise_count(group[i + 1 :] ^ group[i]) <= radius)
            other, at = np.unique(label[near], return_index=True)
            fresh = other != label[i]
            edges.append(np.stack([np.full(fresh.sum(), group[i]), group[near[at[fresh]]]], axis=1))
            label[np.isin(label, other[fresh])] = label[i]
    found = np.concatenate(edges) if edges else np.zeros((0, 2), np.uint64)
    found = found[found[:, 0] != found[:, 1]].view(np.int64)
    return np.unique(np.sort(found, axis=1), axis=0)


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b), a < b: links that connect the distinct fingerprints (column fp) as all links would."""

    def keyed(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for part in np.array_split(values, max(1, len(values) // 4096)):
                row, key = bucket_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(part[row])], ["key", "fp"])

    def met(batches):
        keys, values = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            values = np.concatenate([values, batch.column(1).to_numpy()])
            last = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last run may go on
            if last > 65536:
                yield edges(keys[:last], values[:last])
                keys, values = keys[last:], values[last:]
        if len(keys):
            yield edges(keys, values)

    def edges(keys, values):
        found = bucket_links(keys, values.view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    if not 0 <= radius <= 4:
        raise ValueError("the Golay keys find all links of 4 bits at most")
    # A fingerprint has some 80 keys: dealt out anew, as few bytes may be put together in few tasks.
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = fps.select("fp").where(F.col("fp").isNotNull()).distinct().repartition(parts, "fp")
    keys = distinct.mapInArrow(keyed, "key int, fp long")
    sorted_keys = keys.repartition("key").sortWithinPartitions("key")
    return sorted_keys.mapInArrow(met, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for nodes that have edges (columns a, b).

    Rounds end when the edges' count and the exclusive or of their digests stay as they are. Few
    edges are held in few partitions (SHARE in each), as a round has several exchanges.
    """
    parts, width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), None

    def narrow(df: DataFrame) -> DataFrame:
        return df.coalesce(width) if width is not None and width < parts else df

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first())

    edges = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    held = state(edges)
    while True:
        width = 1 + held[0] // SHARE
        edges = narrow(edges)
        # Large star: neighbours above a node join its least neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = narrow(narrow(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        # Small star: a node and its neighbours below it join the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = narrow(large.join(least, "a"))
        joined = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = checkpoint(narrow(joined.where("a > b").distinct()))
        before, held = held, state(edges)
        if held == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )


def near_duplicates(documents: DataFrame, radius: int = 4, shingle: int = 4, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc, fp (signed long) and component_id, the least id reachable by links."""
    printed = checkpoint(fingerprints(documents.select(F.col(doc).alias("id"), F.col(text).alias("text")), "text", shingle))
    classes = checkpoint(printed.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(classes, radius))
    rooted = classes.join(roots, classes["fp"] == roots["node"]).select("fp", "least", "root")
    # Both sides of the joins below are exchanged as they stand, so that Spark can split a large
    # group's or a frequent fingerprint's rows.
    named = checkpoint(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    members = rooted.join(named, "root").select("fp", "component_id")
    single = classes.join(members, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    every = checkpoint(members.unionByName(single))
    return printed.join(every, "fp").select(F.col("id").alias(doc), "fp", "component_id")
