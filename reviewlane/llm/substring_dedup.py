"""Removal of repeated passages by seed and extend.

A passage is `window` (13) or more consecutive words that an earlier document (smaller
doc_id) also holds. Of every `window` words the word k-gram with the least hash is an
anchor (winnowing), and which one it is depends on those words alone, so two documents
that share a window share its anchor.

1. Seeds. Anchors are exchanged once, by their hash. All holders of an anchor are paired
   with its first holder, the least in order of doc_id and place; no pair of two others is
   built, so an anchor of a third of all documents costs one row for each of them. Holders
   of an anchor that is frequent within one chunk of texts are a group of their own, and only
   the first of them is grouped with other chunks, so that no task gets all holders of one.
2. Extension. A document's seeds name blocks of words of first holders; each such block is
   fetched once and handed to those who ask. Seeds in line with each other are one match.
   Its words are compared with the first holder's outwards from the anchors as far as the
   windows that these are the anchors of, and equal stretches of `window` or more words are
   the maximal repeats kept. No hash decides what is removed.
3. Rest. A window that no first holder of its anchor has may still be held by another
   document. Such windows are paired by 76 bits of their words' digest with their own first
   holder, and these seeds are extended and compared in the same way. A collision of these
   bits removes nothing, but may hide a repeat behind a window with other words.

Texts are exchanged once, by id and 16 bits of their hash; every step joins that exchange.

Defined results: null text has no words; null doc_id counts as larger than any id, so such
rows lose to all others and not to each other; rows of one doc_id never remove each other,
each keeps its own text's result; fewer than `window` words are kept; a very long text is
handled whole, by one task; an empty table gives no rows; other columns pass through
`remove_repeats`, whatever their names.

Limit: rows of equal doc_id and equal text meet in one partition of the texts' exchange.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _WORD_STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 22  # bytes of text handled at once
_LAST = (1 << 63) - 1
_FREQUENT = 4  # holders of an anchor in one chunk from which they are paired there
_BLOCK = 16  # words fetched together

#: A seed's place as one long: 30 bits of the anchor's place, 6 of how far before it its first
#: window starts, 6 of how many more windows it has, 16 of the text's hash, three flags.
_BEFORE, _MORE, _HASH = 30, 36, 42
_REST = (1 << _HASH - _BEFORE) - 1  # of a window, which is its own anchor: more bits of its digest
_MANY, _NEED, _LOCAL = 1 << 58, 1 << 59, 1 << 60


def _place(at):
    return at & ((1 << _BEFORE) - 1)


def _before(at):
    return at >> _BEFORE & 63


def _more(at):
    return at >> _MORE & 63


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(step: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), step, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word of the texts data[offsets[i]:offsets[i + 1]]."""
    inside = ~_SPACE[data]
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[firsts] = False  # a text's first byte follows no word
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(inside)
    word = np.cumsum(inside & ~before)[at] - 1
    place = at - starts[word]
    values = _BYTE[data[at]] * _powers(_STEP, int(place.max()) + 1)[place]
    first = np.searchsorted(at, starts)
    hashes = _mixed(np.add.reduceat(values, first))
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def _rolled(words: np.ndarray, n: int) -> np.ndarray:
    size = len(words) - n + 1
    total = np.zeros(max(size, 0), np.uint64)
    for j in range(n):
        total = total * _WORD_STEP + words[j : j + size]
    return _mixed(total)


def anchors(words: np.ndarray, rows: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(row, hash, place, first window's start, number of windows) of each anchor; places count over all rows."""
    empty = np.zeros(0, np.int64)
    starts = np.flatnonzero(rows[: len(rows) - window + 1] == rows[window - 1 :]) if len(words) >= window else empty
    if not len(starts):
        return empty, empty.view(np.uint64), empty, empty, empty
    grams = _rolled(words, k)
    least, place = grams[starts], starts.copy()
    for j in range(1, window - k + 1):
        other = grams[starts + j]
        better = other <= least  # of equal grams the last, so that places never go back
        least, place = np.where(better, other, least), np.where(better, starts + j, place)
    fresh = np.flatnonzero(np.diff(place, prepend=-1))
    return rows[starts[fresh]], least[fresh], place[fresh], starts[fresh], np.diff(fresh, append=len(starts))


def _chunks(batch: pa.RecordBatch, text: str):
    """(first row, last row, bytes, offsets) of parts of a batch with about _CHUNK bytes of text each."""
    column = batch.column(text).cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + _CHUNK, side="right")) - 1)
        stop = min(stop, len(column))
        yield row, stop, raw[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def _in_local_groups(key: np.ndarray, d: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """key, d and at, where documents that share a frequent key form a group of their own.

    Their rows get a key that no other place has and the flag _LOCAL. The least document's
    rows keep the old key, the first of them with the flag _MANY, and it also leads the group.
    """
    order = np.argsort(key)
    heads = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
    size = np.diff(heads, append=len(key))
    frequent = order[np.repeat(size > _FREQUENT, size)]
    frequent = frequent[np.lexsort((at[frequent], d[frequent], key[frequent]))]
    size = size[size > _FREQUENT]
    first = frequent[np.cumsum(size) - size]
    named = _mixed(key[first].view(np.uint64) + d[first].view(np.uint64) * _STEP + at[first].view(np.uint64) * _WORD_STEP)
    named = (named >> np.uint64(16)).view(np.int64)
    leaders = named, d[first], at[first] | _LOCAL
    others = d[frequent] != np.repeat(d[first], size)
    key, at = key.copy(), at.copy()
    key[frequent[others]] = np.repeat(named, size)[others]
    at[frequent[others]] |= _LOCAL
    at[first] |= _MANY
    return tuple(np.concatenate(x) for x in zip((key, d, at), leaders))  # in order of the texts, which compresses best


def _anchor_rows(texts: DataFrame, window: int, k: int) -> DataFrame:
    """(key, d, at): each anchor of each text.

    key is 48 bits of the anchor's hash, or of another where the anchor is frequent in its chunk.
    """

    def run(batches):
        for batch in batches:
            ids, marks = batch.column("d").to_numpy(), batch.column("s").to_numpy().astype(np.int64)
            for lo, hi, data, offsets in _chunks(batch, "t"):
                words, rows = hashed_words(data, offsets)
                row, key, place, start, n = anchors(words, rows, window, k)
                begin = np.searchsorted(rows, np.arange(hi - lo))
                d = ids[lo:hi][row]
                at = (place - begin[row]) | (place - start) << _BEFORE | (n - 1) << _MORE | marks[lo:hi][row] << _HASH
                out = _in_local_groups((key >> np.uint64(16)).view(np.int64), d, at)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["key", "d", "at"])

    return texts.mapInArrow(run, "key long, d long, at long")


def _mark(at: str) -> Column:
    return F.shiftright(at, _HASH).bitwiseAND(0xFFFF).cast("int")


def _seeds(rows: DataFrame) -> DataFrame:
    """(d, s, at, m, mat): anchors with their first holder m, mat; without one where only their windows are needed.

    The flag _NEED says that windows which the first holder lacks may be held by others.
    """
    group = Window.partitionBy("key").orderBy("d", "at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    joined = rows.select(
        "d", "at", F.first("d").over(group).alias("m"), F.first("at").over(group).alias("mat"), F.last("d").over(group).alias("last"),
        F.count(F.lit(1)).over(group).alias("n"), F.bit_or(F.col("at").bitwiseAND(_MANY | _LOCAL)).over(group).alias("flags"),
    )
    follows = F.col("d") > F.col("m")
    leads = (F.col("d") == F.col("m")) & (F.col("at") == F.col("mat"))
    some = F.col("flags") > 0
    # All of a group are compared with its first holder, so its windows need no more; but those of other chunks are not.
    windows = F.when(leads, F.col("flags").bitwiseAND(_MANY) > 0).otherwise((F.col("last") > F.col("m")) | some)
    need = ~follows | (F.col("n") > 2) | some
    return joined.where(follows | windows).select(
        "d", _mark("at").alias("s"), F.when(need, F.col("at").bitwiseOR(_NEED)).otherwise(F.col("at")).alias("at"),
        F.when(follows, F.col("m")).alias("m"), F.when(follows, F.col("mat")).alias("mat"),
    )


def _grouped(seeds: DataFrame) -> DataFrame:
    # Joins ask for keys that are not null; asked here, all of them see one plan, whose exchange Spark reuses.
    known = seeds.where(F.col("d").isNotNull() & F.col("s").isNotNull())
    return known.groupBy("d", "s").agg(F.collect_list(F.struct("at", "m", "mat")).alias("seeds"))


def _fields(column: pa.ListArray, *names: str) -> tuple[list[int], list[np.ndarray]]:
    """Ends of the rows of a column of arrays of structs, and the structs' fields as one array each."""
    inner, lengths = column.flatten(), column.value_lengths().fill_null(0).to_numpy()
    parts = dict(zip((f.name for f in inner.type), inner.flatten()))
    return [0, *np.cumsum(lengths).tolist()], [parts[n] for n in names]


def _asks(grouped: DataFrame, window: int) -> DataFrame:
    """(d, s, m, ms, b): the blocks of the first holders' words that a document's seeds need."""

    def run(batches):
        for batch in batches:
            ends, (at, m, mat) = _fields(batch.column("seeds"), "at", "m", "mat")
            known = m.is_valid().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[known]
            at, m, mat = at.to_numpy()[known], m.fill_null(0).to_numpy()[known], mat.fill_null(0).to_numpy()[known]
            a = _place(mat) - _before(at)
            first, last = np.maximum(a, 0) // _BLOCK, (a + _more(at) + window - 1) // _BLOCK
            n = last - first + 1
            take = np.repeat(np.arange(len(n)), n)
            block = first[take] + np.arange(len(take)) - np.repeat(np.cumsum(n) - n, n)
            rows = np.unique(np.stack([owner[take], m[take], (mat >> _HASH & 0xFFFF)[take], block], 1), axis=0) if len(take) else np.zeros((0, 4), np.int64)
            columns = [batch.column("d").take(pa.array(rows[:, 0])), batch.column("s").take(pa.array(rows[:, 0])), rows[:, 1], rows[:, 2].astype(np.int32), rows[:, 3]]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["d", "s", "m", "ms", "b"])

    return grouped.select("d", "s", "seeds").mapInArrow(run, "d long, s int, m long, ms int, b long")


def _provided(asked: DataFrame) -> DataFrame:
    """(m, ms, b, words): each asked block; asked has the texts' columns and blocks, rows of one key beside each other."""

    def run(batches):
        last = None
        for batch in batches:
            out = ([], [], [], [])
            for d, s, t, blocks in zip(batch.column("d").to_pylist(), batch.column("s").to_pylist(), batch.column("t"), batch.column("blocks").to_pylist()):
                text = t.as_py() or b""
                if (d, s, text) == last:  # a repeated row
                    continue
                last = (d, s, text)
                words = text.split()
                for b in blocks:
                    found = words[b * _BLOCK : (b + 1) * _BLOCK]
                    if found:
                        for column, x in zip(out, (d, s, b, b" ".join(found))):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["m", "ms", "b", "words"])

    return asked.mapInArrow(run, "m long, ms int, b long, words binary")


def matches(at: list[int], m: list[int | None], mat: list[int], window: int) -> list[tuple]:
    """(start, end, holder, shift) of the stretches to compare: seeds in line with each other are one."""
    out: list[list] = []
    for i in sorted(range(len(at)), key=lambda i: _place(at[i])):
        if m[i] is None:
            continue
        start = _place(at[i]) - _before(at[i])
        end, holder, shift = start + _more(at[i]) + window, (m[i], mat[i] >> _HASH & 0xFFFF), _place(mat[i]) - _place(at[i])
        if out and out[-1][2:] == [holder, shift] and start <= out[-1][1]:
            out[-1][1] = end
        else:
            out.append([start, end, holder, shift])
    return [tuple(x) for x in out]


def extended(words: list[bytes], match: tuple, blocks: dict, window: int) -> list[tuple[int, int]]:
    """The maximal stretches of `window` or more words in which both documents agree within a match."""
    start, end, holder, shift = match
    start, end = max(start, -shift, 0), min(end, len(words))
    found = []
    options = [blocks.get((*holder, b), []) for b in range((start + shift) // _BLOCK, (end + shift - 1) // _BLOCK + 1)]
    for i in range(max(map(len, options), default=0)):  # more than one only if texts of one id agree in their hash
        theirs: list = []
        for held in options:
            one = held[min(i, len(held) - 1)] if held else []
            theirs += [*one, *[None] * (_BLOCK - len(one))]
        theirs = theirs[(start + shift) % _BLOCK :]
        mine = words[start:end]
        if mine == theirs[: len(mine)]:
            if len(mine) >= window:
                found.append((start, end))
            continue
        begin = 0
        for j in range(len(mine) + 1):
            if j == len(mine) or mine[j] != theirs[j]:
                if j - begin >= window:
                    found.append((start + begin, start + j))
                begin = j + 1
    return found


def _digest(words: list[bytes]) -> tuple[int, int]:
    """64 and 12 bits of the words' digest."""
    raw = hashlib.blake2b(b" ".join(words), digest_size=10).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little") & _REST


def _compared(asked: DataFrame, window: int) -> DataFrame:
    """(key, d, at, th, lo, hi): the repeats found in each text, and its windows that others may hold.

    A repeat has th, lo and hi; a window has none of them, and its digest is the key with 12 more bits in `at`.
    """
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2
    names = ["key", "d", "at", "th", "lo", "hi"]

    def run(batches):
        for batch in batches:
            ends, (at, m, mat) = _fields(batch.column("seeds"), "at", "m", "mat")
            at, m, mat = at.to_pylist(), m.to_pylist(), mat.to_pylist()
            stops, fields = _fields(batch.column("answers"), "m", "ms", "b", "words")
            fields = [x.to_pylist() for x in fields]
            out, keys, ids, places = [], [], [], []
            for i, (d, s, th, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("d", "s", "th", "t")))):
                words = (t or b"").split()
                blocks = defaultdict(list)
                for j in range(stops[i], stops[i + 1]):
                    blocks[fields[0][j], fields[1][j], fields[2][j]].append(fields[3][j].split())
                here = slice(ends[i], ends[i + 1])
                repeats = [r for x in matches(at[here], m[here], mat[here], window) for r in extended(words, x, blocks, window)]
                out += [((lo * 0x9E3779B1 ^ th), d, s << _HASH, th, lo, hi) for lo, hi in repeats]
                need = [x for x in at[here] if x & _NEED]
                if need:
                    known = np.zeros(len(words) + 1, np.int64)
                    for lo, hi in repeats:
                        known[lo] += 1
                        known[hi - window + 1] -= 1
                    known = np.cumsum(known).tolist()
                    starts = {w for x in need for w in range(_place(x) - _before(x), _place(x) - _before(x) + _more(x) + 1)}
                    for w in sorted(starts):
                        if 0 <= w <= len(words) - window and not known[w]:
                            key, rest = _digest(words[w : w + window])
                            keys.append(key)
                            ids.append(d)
                            places.append(w | rest << _BEFORE | s << _HASH)
            columns = zip(*out) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], names)
            windows = _in_local_groups(*(np.array(x, np.int64) for x in (keys, ids, places)))
            none = [pa.nulls(len(windows[0]), kind) for kind in kinds[3:]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, windows), *none], names)

    return asked.mapInArrow(run, "key long, d long, at long, th long, lo int, hi int")


def _extended_seeds(texts: DataFrame, seeds: DataFrame, window: int) -> DataFrame:
    """_compared() of all texts that have seeds, with the first holders' words fetched."""
    grouped = _grouped(seeds)
    asks = _asks(grouped, window)
    wanted = asks.groupBy(F.col("m").alias("d"), F.col("ms").alias("s")).agg(F.collect_set("b").alias("blocks"))
    provided = _provided(texts.join(wanted, ["d", "s"]))
    answers = asks.join(provided, ["m", "ms", "b"]).groupBy("d", "s").agg(F.collect_list(F.struct("m", "ms", "b", "words")).alias("answers"))
    return _compared(texts.join(grouped, ["d", "s"]).join(answers, ["d", "s"], "left"), window)


def _window_seeds(rows: DataFrame) -> DataFrame:
    """Seeds of the windows that a smaller document also has, with the first holder of each.

    Repeats are left out only after the grouping, and _repeats() reads all columns: so both
    ask for the same exchange, and Spark compares the texts once.
    """
    rest = F.shiftright("at", _BEFORE).bitwiseAND(_REST)
    group = Window.partitionBy("key", rest).orderBy("d", "at")
    first = [F.first(c).over(group).alias(a) for c, a in (("d", "m"), ("at", "mat"))]
    held = rows.select("d", _mark("at").alias("s"), "at", *first, "th", "lo", "hi").where("d > m")
    plain = lambda c: F.col(c).bitwiseAND((1 << _BEFORE) - 1 | 0xFFFF << _HASH).alias(c)
    return held.where("th IS NULL AND lo IS NULL AND hi IS NULL").select("d", "s", plain("at"), "m", plain("mat"))


def _repeats(rows: DataFrame) -> DataFrame:
    """(d, at, th, lo, hi): the repeats among the rows."""

    def run(batches):
        for batch in batches:
            yield batch.filter(batch.column("th").is_valid()).select(["d", "at", "th", "lo", "hi"])

    return rows.mapInArrow(run, "d long, at long, th long, lo int, hi int")


def remove_repeats(
    documents: DataFrame, window: int = 13, k: int = 5, doc: str = "doc_id", text: str = "text", keep_text: bool = True
) -> DataFrame:
    """documents with n_words, n_removed and, as `text`, the kept words joined by one space.

    Without keep_text the text's SHA-256 stands in kept_sha256 and the text is dropped.
    Columns of these names are replaced. window - k may be 63 at most.
    """
    if not 1 <= k <= window or window - k > 63:
        raise ValueError("k must lie between 1 and window, and window - k under 64")
    added = ["n_words", "n_removed", "kept_sha256"]
    own = [c for c in documents.columns if c not in added and c != text]
    held = [f"_own{i}" for i in range(len(own))]  # names that clash with none used here
    th = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    # All steps take all of these columns, so that Spark can reuse one exchange for them.
    texts = documents.select(
        F.coalesce(F.col(doc), F.lit(_LAST)).alias("d"),
        th.bitwiseAND(0xFFFF).cast("int").alias("s"),
        th.alias("th"),
        F.col(text).cast("binary").alias("t"),
        *(F.col(c).alias(x) for c, x in zip(own, held)),
    )
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seeds = _seeds(_anchor_rows(texts, window, k).repartition(parts, "key"))
    compared = _extended_seeds(texts, seeds, window).repartition(parts, "key")
    again = _extended_seeds(texts, _window_seeds(compared), window)
    found = _repeats(compared).unionByName(_repeats(again))  # seeds of windows ask for no more windows
    repeats = found.groupBy("d", _mark("at").alias("s")).agg(F.collect_set(F.struct("th", "lo", "hi")).alias("repeats"))
    judged = texts.join(repeats, ["d", "s"], "left")

    kept = [*own, *added[:2], text if keep_text else added[2]]
    schema = T.StructType(
        [documents.schema[c] for c in own]
        + [T.StructField(c, T.LongType()) for c in added[:2]]
        + [T.StructField(kept[-1], T.StringType())]
    )

    def run(batches):
        for batch in batches:
            ends, fields = _fields(batch.column("repeats"), "th", "lo", "hi")
            whose, lo, hi = (x.to_pylist() for x in fields)
            counts, removed, out = [], [], []
            for i, (t, th) in enumerate(zip(batch.column("t"), batch.column("th").to_pylist())):
                words = (t.as_py() or b"").split()
                steps = np.zeros(len(words) + 1, np.int64)
                for j in range(ends[i], ends[i + 1]):
                    if whose[j] == th:
                        steps[lo[j]] += 1
                        steps[hi[j]] -= 1
                left = words
                if ends[i] < ends[i + 1]:
                    left = [w for w, gone in zip(words, np.cumsum(steps[:-1]).tolist()) if not gone]
                joined = b" ".join(left)
                counts.append(len(words))
                removed.append(len(words) - len(left))
                out.append(joined.decode() if keep_text else hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in held), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())],
                kept,
            )

    return judged.mapInArrow(run, schema)
