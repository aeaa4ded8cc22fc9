"""Columns of reserved names, long and skewed rows, and paths that small tables do not take."""

import random
import time
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlane.llm import bpe, decontaminate, licenses, secrets, sharding, simhash, toxicity

RESERVED = [
    "_key", "_kinds", "_found", "_contamination", "_toxicity", "_rank", "_sub", "_part", "_a", "_b", "_ends", "_start", "_at", "_own0", "_own1",
    "key", "kinds", "salt", "found", "part", "sub", "rank", "ends", "at", "n", "start", "piece", "spans", "n_words", "n_hit", "item_ids", "fp", "id", "score", "h",
]


@pytest.fixture(scope="module")
def named(spark):
    rows = [(i, f"password: hunter2hunter2 {'ab12' * 9} text {i}", *RESERVED) for i in range(6)]
    return spark.createDataFrame(rows, ["doc_id", "text", *RESERVED])


def passed(out, without=()):
    rows = out.collect()
    assert rows and all(r[n] == n for r in rows for n in RESERVED if n not in without)
    return rows


def test_reserved_names(spark, named):
    items = spark.createDataFrame([("a", " ".join(f"w{i}" for i in range(20)))], "item_id string, text string")
    assert all(r.secrets for r in passed(secrets.scan(named)))
    passed(decontaminate.contamination(named, items))
    passed(decontaminate.decontaminate(named, items))
    passed(decontaminate.decontaminate(named, items, remove="spans"))
    passed(licenses.scan(named), {"n_words", "score"})
    assert {r.shard for r in passed(sharding.shard_rows(named, [F.col("doc_id"), F.col("text")], n_shards=3))} <= {0, 1, 2}
    model = toxicity.fit(named, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    passed(toxicity.reject_toxic(named, model))
    passed(toxicity.score(named, model), {"score"})


def test_bpe_and_simhash_columns(named):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    passed(bpe.encode_decode(named, public_tokenizers.path("word_bpe_49k.json")))
    passed(bpe.encode_decode(named.limit(0).unionByName(named), public_tokenizers.path("word_bpe_49k.json")))
    passed(simhash.fingerprints(named), {"fp"})


def test_empty_tables(spark, named):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    none = named.limit(0)
    assert bpe.encode_decode(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert secrets.scan(none).withColumn("clean", secrets.redact(F.col("text"), F.col("secrets"))).count() == 0
    model = toxicity.fit(named, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert toxicity.reject_toxic(none, model).count() == 0


def test_case_of_the_assign_rule(spark):
    """Only A-Z fold: the long s and the Kelvin sign are no letters of these words."""
    texts = ["PassWord=abcdefgh", "paſſword=abcdefgh", "toKen=abcdefgh", "API_KEY: 'abcdefgh1", "apikey=abcdefgh"]
    out = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in out.collect() if r.secrets} == {0, 3, 4}


def test_a_text_on_many_rows_is_searched(spark):
    rows = [(i, "token = abcdefgh12") for i in range(500)]
    out = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [len(r.secrets) for r in out.collect()] == [1] * 500


@pytest.fixture(scope="module")
def contaminated(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(f"i{i}", " ".join(word() for _ in range(n))) for i, n in enumerate([20, 13, 14, 5, 1, 40])]
    texts = [" ".join(word() for _ in range(rng.randrange(300))) for _ in range(20)]
    texts += [f"{texts[i]} {items[i % 6][1]} {texts[i + 1]}" for i in range(12)] + [" ".join(x for _, x in items) * 3, "", None]
    rows = [*enumerate(texts), (None, texts[20]), (3, texts[21]), (3, texts[21])]
    return rows, items


@pytest.mark.parametrize("limit", [0, 10**6])
def test_decontamination_paths(spark, contaminated, limit):
    """Windows at piece bounds, items shorter than a window, and the path without a broadcast."""
    rows, items = contaminated
    out = decontaminate.contamination(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), broadcast_windows=limit
    )
    got = Counter(tuple(r) for r in out.select("doc_id", "contamination.n_words", "contamination.n_hit", F.size("contamination.item_ids"), "contamination.contaminated").collect())
    assert got == Counter((r[0], r[1], r[2], r[3], r[5]) for r in brute.contamination(rows, items))


def test_removal_of_spans(spark):
    items = spark.createDataFrame([("a", " ".join(f"b{i}" for i in range(13)))], "item_id string, text string")
    text = "One two, " + " ".join(f"B{i}" for i in range(13)) + ". Three four!"
    out = decontaminate.decontaminate(spark.createDataFrame([(1, text), (2, "One")], "doc_id long, text string"), items, remove="spans")
    assert {r.doc_id: r.text for r in out.collect()} == {1: "One two, Three four!", 2: "One"}


def test_long_texts_cost_what_their_words_cost(spark):
    machine = licenses.automaton()

    def seconds(n):
        began = time.process_time()
        found = licenses.scan_text("cc by nc " * n, machine)
        assert found[1] == n and found[3] == 3 * (n - 1)
        return time.process_time() - began

    assert seconds(80_000) < 20 * max(seconds(10_000), 0.005)
    items = spark.createDataFrame([("a", " ".join(f"w{i}" for i in range(100, 113)))], "item_id string, text string")
    text = " ".join(f"w{i % 5000}" for i in range(200_000))
    r = decontaminate.contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), items).first().contamination
    assert (r.n_words, r.n_hit) == (200_000, 13 * 40)


def test_long_words_merge_exactly():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(2)
    with open(path) as f:
        import json

        coder = bpe.WordBpe(json.load(f))
    words = ["".join(rng.choices("abcdeilnorst", k=n)) for n in (1, 2, 3, 50, 500, 5000)]
    assert [brute.sha(x) for x in coder.encode_batch(words)] == [r[2] for r in brute.tokens(list(enumerate(words)), path)]
    assert coder.repaired


@pytest.mark.parametrize("text, labels", [
    ("SPDX-License-Identifier: MIT and then we ship it", {"mit"}),
    ("SPDX-License-Identifier: (MIT or Apache-2.0) AND Zlib", {"mit", "apache-2.0", "zlib"}),
    ("SPDX-License-Identifier: MIT AND then more", {"mit"}),
    ("SPDX-License-Identifier: curl", {"curl"}),
    ("SPDX-License-Identifier: see below", set()),
])
def test_expressions_end_at_prose(text, labels):
    found = licenses.scan_text(text, licenses.automaton())
    assert set(filter(None, found[5].split(","))) == labels


def test_license_score_is_that_of_the_best_evidence():
    score = lambda t: licenses.scan_text(t, licenses.automaton())[6]
    assert score("SPDX-License-Identifier: MIT") == 1.0
    assert score("SPDX-License-Identifier: GPL-3.0-only") == 0.5
    assert score("used under the MIT License here") == 0.9
    assert score("the MIT license") == 0.6
    assert score("nothing") == 0.0


def test_golay_radius_is_bounded(spark):
    fps = spark.createDataFrame([(1,)], "fp long")
    with pytest.raises(ValueError):
        simhash.links(fps, radius=5)


def test_simhash_groups_of_many_copies(spark):
    rng = random.Random(7)
    base = [f"t{rng.randrange(500)}" for _ in range(300)]
    rows = [(i, " ".join(base)) for i in range(200)]
    rows += [(1000 + i, " ".join(base[:i] + ["edit"] + base[i + 1 :])) for i in range(60)] + [(None, " ".join(base)), (5, "other")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.component_id) for r in out.collect()) == Counter((r[0], r[2]) for r in brute.groups(rows))


def test_matrix_beyond_a_billion_rows():
    counts = np.array([5 * 10**9, 0, 3, 7 * 10**9 + 1, 10**10])
    matrix = sharding.communication_matrix(counts, 40, 1)
    assert (matrix.sum(axis=1) == counts).all() and (matrix >= 0).all()
    sizes = matrix.sum(axis=0)
    assert sizes.max() - sizes.min() <= 1 and sizes.sum() == counts.sum()
    # Each number is near its mean, some standard deviations away at most, and not at it.
    mean = counts[0] / 40
    away = (matrix[0] - mean) / np.sqrt(mean * (1 - 1 / 40) * (1 - counts[0] / counts.sum()))
    assert 0.5 < away.std() < 2 and abs(away).max() < 6


def test_inversion_has_the_law_of_numpy(monkeypatch):
    rng = np.random.default_rng(4)
    want = rng.hypergeometric(300, 500, 200, 4000)
    monkeypatch.setattr(sharding, "_NUMPY_BOUND", 0)
    got = np.array([sharding.hypergeometric(300, 500, 200, rng) for _ in range(4000)])
    assert abs(got.mean() - want.mean()) < 0.6 and abs(got.std() / want.std() - 1) < 0.06
    assert sharding.hypergeometric(5, 0, 3, rng) == 3 and sharding.hypergeometric(0, 5, 3, rng) == 0
    assert sharding.hypergeometric(5, 7, 12, rng) == 5 and sharding.hypergeometric(5, 7, 0, rng) == 0


def test_the_index_keeps_regexes_from_other_texts(spark):
    """A rule whose pattern fails on a long text in time: only candidates may meet it."""
    slow = secrets.Rule("slow", r"needle(?:[a-z]+)+!", 0, 0)  # exponential on letters after the word
    rows = [(i, f"haystack {'x' * 50_000} {i}") for i in range(8)] + [(9, "needle" + "ab" * 3 + "!"), (10, None)]
    began = time.monotonic()
    out = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), [slow, *secrets.RULES])
    assert {r.doc_id for r in out.collect() if r.secrets} == {9}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert time.monotonic() - began < 60


def test_long_runs_of_letters_are_searched_in_time(spark):
    rng = random.Random(1)
    run = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    rows = [(1, run(100_000) + " http://u:pw@h"), (2, run(50_000) + "://" + run(50_000)), (3, "://" + run(100_000))]
    began = time.monotonic()
    found = {r.doc_id: [s.kind for s in r.secrets] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: ["url_login"], 2: [], 3: []}
    assert time.monotonic() - began < 20
