"""Hard negatives, source divergence and exact deduplication against brute force, with odd rows."""

import math
import random
import uuid
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlane.llm import divergence, exact_dedup, negatives

# --- hard negatives -------------------------------------------------------------------------


def mined(rows, n_positives=5, k=5, low=80, high=100, scale=256):
    usable = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda s, i: (-s, i is None, i or 0)
    out = []
    for a, (anchor, label, mine) in enumerate(usable):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(x * y for x, y in zip(mine, v)), i, other) for b, (i, other, v) in enumerate(usable) if b != a]
        same = sorted(((s, i) for s, i, other in scored if other == label), key=lambda x: order(*x))[:n_positives]
        for p, positive in same:
            hard = sorted(((s, i) for s, i, other in scored if other != label and low * p <= 100 * s <= high * p), key=lambda x: order(*x))[:k]
            out += [(anchor, positive, rank, i, p, s) for rank, (s, i) in enumerate(hard, 1)]
    return Counter(out)


HOSTILE = ["uid", "id", "vector", "anchor", "cell", "asks", "carried", "score", "place", "rank"]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, *[None] * len(HOSTILE)) for i, label, v in rows], "vec_id long, embedding array<float>, label int, " + ", ".join(f"{n} string" for n in HOSTILE))


def odd_vectors():
    rng = random.Random(4)
    few = lambda: [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(6)]  # noqa: E731  many ties
    rows = [(i, rng.randrange(4), few()) for i in range(0, 800, 4)]
    rows += [(100, 1, few()), (100, 1, few()), (200, 2, [0.5] * 6), (200, 2, [0.5] * 6), (None, 1, [0.5] * 6), (None, 2, [0.5] * 6)]
    rows += [(300, None, few()), (500, 3, None), (600, 0, [0.5, None] + [0.5] * 4), (601, 0, [math.nan] * 6), (602, 0, [math.inf] + [0.0] * 5)]
    rows += [(700, 2, []), (701, 3, [0.5, 0.5]), (900, 77, few())]
    return rows


def found(df):
    return Counter(tuple(r) for r in df.collect())


def test_negatives(spark):
    rows = odd_vectors()
    want = mined(rows)
    assert len(want) > 50 and any(r[1] is None or r[3] is None for r in want)
    assert found(negatives.mine(vectors(spark, rows), F.col("vec_id") % 100 == 0)) == want


def test_negatives_in_many_small_cells(spark, monkeypatch):
    monkeypatch.setattr(negatives, "TEAM_BYTES", 3 * 8 * 6)
    monkeypatch.setattr(negatives, "CHUNK_ROWS", 20)
    monkeypatch.setattr(negatives, "POOL", 8)
    rows = odd_vectors()
    got = negatives.mine(vectors(spark, rows), F.col("vec_id") % 100 == 0, n_positives=3, k=4, low=50, high=90)
    assert found(got) == mined(rows, 3, 4, 50, 90)


def test_negatives_with_a_hot_label_and_none(spark):
    rng = random.Random(9)
    rows = [(i, 0 if i % 3 else i % 5, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(1200)]
    assert found(negatives.mine(vectors(spark, rows), F.col("vec_id") % 100 == 0)) == mined([(i, label, [float(np.float32(x)) for x in v]) for i, label, v in rows])
    assert negatives.mine(vectors(spark, rows).limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(vectors(spark, rows), F.lit(None).cast("boolean")).count() == 0


def test_scores_beyond_doubles_are_exact():
    block = np.array([[2.0**40 + 1, 3.0], [1.0, -(2.0**40)]])
    assert negatives.scores(block, np.array([2.0**20 + 1, 5.0])).tolist() == [(2**40 + 1) * (2**20 + 1) + 15, 2**20 + 1 - 5 * 2**40]
    with pytest.raises(OverflowError):
        negatives.scores(np.array([[2.0**100]]), np.array([2.0**100]))


# --- source divergence ----------------------------------------------------------------------


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalpha():
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def audited(rows, least_docs, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", words(text)
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        held = lambda s: {t: counts[lang, s][t] for t in kept}  # noqa: E731, B023
        whole = {t: sum(counts[g][t] for g in groups if g[0] == lang) for t in kept}
        p = lambda c: {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(c)) for t, n in c.items()}
        own, q = p(held(source)), p(whole)
        pairs = [(sum(abs(own[t] - its[t]) for t in kept), s) for (other, s) in groups if other == lang and s != source for its in [p(held(s))]]
        above = [(own[t] - q[t], t) for t in kept if counts[lang, source][t] and own[t] > q[t]]
        for part, found, limit in (("pair", pairs, None), ("term", above, top)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
            out += [(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return Counter(out)


def odd_texts():
    rng = random.Random(7)
    vocabulary = [f"w{c}" for c in "abcdefghij"] + ["Ünder", "ünder", "naïve", "ſtraße", "日本", "é", "UPPER", "x" * 50 + "a", "x" * 50 + "b"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s0", "s0", "s0", "s1", "s2", None]), " ".join(rng.choices(vocabulary, k=rng.randrange(12)))) for _ in range(150)]
    rows += [("en", "empty", None), ("en", "empty", ""), ("fr", "s0", "rare words only"), ("fr", "s9", "1 2 3"), ("en", "s1", "long " + "word1tail," * 30_000)]
    return rows + rows[:5]


@pytest.mark.parametrize("held", [divergence.HELD_TERMS, 3])
def test_divergence(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    rows = odd_texts()
    documents = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "lang string, source string, text string, term string, n int, p string")
    assert found(divergence.audit(documents, least_docs=4, top=3)) == audited(rows, 4, 3)
    assert divergence.audit(documents.limit(0)).count() == 0
    assert found(divergence.audit(documents)) == audited(rows, 30, 50)


def test_largest_with_ties_that_share_long_beginnings(spark):
    rng = random.Random(3)
    items = ["a" * 40 + x for x in "abcdefgh"] + ["a" * 40, "a", "ab", "\U0001f600", "￿", "é", "z"]
    rows = [("g", 7, x) for x in items] + [("g", 2**30, "big"), ("h", 5, "only")] + [("k", rng.randrange(2**30), f"i{i}") for i in range(500)]
    frame = spark.createDataFrame(rows, "g string, value long, item string")
    for k in (1, 3, 5, 14, 600):
        want = []
        for g in "ghk":
            want += sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))[:k]
        assert found(divergence.largest(frame, ["g"], "value", "item", k)) == Counter(want)


def test_shares_are_exact_beyond_longs(spark):
    n, total, v = 2 * 10**18, 5 * 10**18, 10**7
    row = spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(divergence.share("n", "total", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (total + 5 * v)


# --- exact deduplication --------------------------------------------------------------------


def deduplicated(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups["".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")].append((i, text or ""))
    out = []
    for body, members in groups.items():
        stays = min(range(len(members)), key=lambda m: (-len(members[m][1]), members[m][0] is None, members[m][0] or 0))
        out += [(i, members[stays][0], len(members), m == stays, brute.sha(body)) for m, (i, _) in enumerate(members)]
    return Counter(out)


def odd_rows():
    spaced = ["a b c", "abc", "a\tbc ", "a\x0bb\x0cc\r\n", "a bc", "a bc", "ABC", "a\x00bc"]
    rows = [*enumerate(spaced * 3), (50, None), (51, ""), (52, " \n"), (None, "abc   long"), (None, "abclong"), (7, "abc   long")]
    rows += [(60, "same"), (60, "same"), (60, "same"), (61, "s a m e"), (62, "x" * 300_000), (63, "x" * 300_000 + " ")]
    return rows


def test_exact_dedup(spark):
    rows = odd_rows()
    frame = spark.createDataFrame([(i, t, *"abcdefg") for i, t in rows], "doc_id long, text string, key string, digest string, file string, row string, body string, n string, _metadata string")
    assert found(exact_dedup.dedup_rows(frame)) == deduplicated(rows)
    assert exact_dedup.dedup_rows(frame.limit(0)).count() == 0


def test_texts_of_one_digest_are_told_apart_by_their_bytes(spark):
    rows = odd_rows() + [(i, f"text {i % 40}") for i in range(100, 220)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(exact_dedup.dedup_rows(frame, key_bytes=0)) == deduplicated(rows)


def test_streams_go_on_where_they_stopped(spark):
    folder = f"{exact_dedup.shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    first, second = odd_rows(), [(70, "abc      "), (71, "new"), (72, "same")]
    before = [spark.conf.get(k, None) for k in exact_dedup.STATE]
    for rows in (first, second):
        spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(f"{folder}/in")
        got = exact_dedup.dedup(spark, f"{folder}/in", folder)
        digests = spark.read.parquet(f"{folder}/digests").count()
    assert digests == len(first) + len(second)  # no file was read twice
    assert found(got) == deduplicated(first + second)
    assert [spark.conf.get(k, None) for k in exact_dedup.STATE] == before


def test_queries_read_what_they_should(spark, sf):
    from reviewlane.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(QUERIES["op13_exact_dedup"](spark, sf)) == deduplicated(rows)
    rows = [(r.lang, r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(QUERIES["op12_divergence"](spark, sf)) == audited(rows, 30, 50)
