"""Seed and extend on small vocabularies, where anchors and windows meet in every way."""

import random
from collections import Counter

import brute
import pytest

from reviewlane.llm import substring_dedup


def check(spark, rows, window, k):
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    out = substring_dedup.remove_repeats(documents, window=window, k=k, keep_text=False)
    got = Counter(tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    want = Counter(brute.repeats(rows, window))
    assert got == want
    return sum(r[2] for r in want.elements())


@pytest.mark.parametrize("seed, letters, window, k", [(1, "ab", 4, 2), (2, "abc", 4, 1), (3, "abcdef", 5, 3), (4, "abcdefgh", 3, 3), (5, "abcd", 13, 5)])
def test_random_words(spark, seed, letters, window, k):
    rng = random.Random(seed)
    ids = [*range(30), 7, 7, None, None, None]
    rows = [(i, " ".join(rng.choices(letters, k=rng.randrange(0, 30)))) for i in ids]
    base = rng.choices(letters, k=40)
    rows += [(100 + i, " ".join([*rng.choices(letters, k=5), *base[i : i + 25], *rng.choices(letters, k=5)])) for i in range(10)]
    rows += [rows[3], (None, rows[4][1]), (200, rows[4][1])]
    assert check(spark, rows, window, k) > 0


def test_passage_in_all_documents(spark):
    """A passage that is frequent in every chunk, with other words around it and cut at many places."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    words = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(300):
        a, b = sorted((rng.randrange(0, 30), rng.randrange(30, 61)))
        rows.append((rng.randrange(1000), " ".join([*words(rng.randrange(0, 20)), *passage[a:b], *words(rng.randrange(0, 20))])))
    assert check(spark, rows, 13, 5) > 0


def test_window_that_first_holders_lack(spark):
    """The anchor's first holder has other words around it; two later documents share a window."""
    rng = random.Random(4)
    core = [f"c{i}" for i in range(5)]
    around = lambda: [f"x{rng.randrange(10**9)}" for _ in range(12)]
    left, right = around(), around()
    rows = [(1, " ".join(around() + core + around()))]
    rows += [(i, " ".join(around() + left + core + right + around())) for i in (2, 3, 4)]
    assert check(spark, rows, 13, 5) > 0


def test_extension_compares_words():
    words = [b"a", b"b", b"c", b"d", b"e", b"f"]
    match = (0, 6, (1, 7), 2)
    theirs = [b"-", b"-", b"a", b"b", b"c", b"X", b"e", b"f"]
    blocks = {(1, 7, 0): [theirs]}
    assert substring_dedup.extended(words, match, blocks, 3) == [(0, 3)]
    assert substring_dedup.extended(words, match, blocks, 2) == [(0, 3), (4, 6)]
    assert substring_dedup.extended(words, match, {}, 2) == []


def test_columns_of_reserved_names(spark):
    names = ["d", "s", "t", "th", "_own0", "seeds", "answers", "blocks", "repeats", "key", "key2", "at", "m", "mat"]
    documents = spark.createDataFrame([(1, "a b c", *names), (2, "a b c", *names)], ["doc_id", "text", *names])
    out = substring_dedup.remove_repeats(documents, window=3, k=2).collect()
    assert all([r[n] for n in names] == names for r in out)
    assert sorted((r.doc_id, r.text, r.n_removed) for r in out) == [(1, "a b c", 0), (2, "", 3)]


def test_bounds_of_parameters(spark):
    documents = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    for window, k in ((3, 4), (80, 5), (3, 0)):
        with pytest.raises(ValueError):
            substring_dedup.remove_repeats(documents, window=window, k=k)
