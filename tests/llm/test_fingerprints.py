"""Sketches against sets: what subtraction and peeling recover, also from the printed fingerprint."""

import random
import re

import pytest

from reviewlane.llm import fingerprints

PIECE = re.compile(r"[^ \t\n\x0b\f\r]+(?:[ \t]+[^ \t\n\x0b\f\r]+){0,31}")


def pieces(text):
    return set(PIECE.findall(text or ""))


def likeness(a, b):
    a, b = pieces(a), pieces(b)
    return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    line = lambda: " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 50)))
    held = [line() for _ in range(30)]
    texts = ["\n".join(rng.choice([line(), rng.choice(held)]) for _ in range(n)) for n in (0, 1, 2, 5, 9, 30, 60, 150, 400)]
    return list(enumerate([*texts, texts[4], None, "", " \n "]))


@pytest.mark.parametrize("how", [{}, {"cells": 6, "growth": 2, "tries": 2}, {"cells": 6, "growth": 4, "tries": 5}])
def test_likeness_equals_that_of_sets(spark, rows, how):
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in fingerprints.compare_versions(documents, **how).collect()}
    assert len(out) == len(rows)
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        t, following = t or "", following or ""
        half = len(t) // 2
        assert out[i].near_edited == pytest.approx(likeness(t, t[: len(t) - half] + following[:half]), abs=1e-12)
        assert out[i].near_next == pytest.approx(likeness(t, following), abs=1e-12)
    assert out[4].fingerprint == out[9].fingerprint


def read(fingerprint):
    body = fingerprint[8:]
    return {int(body[i : i + 4], 16): tuple(int(body[a:b], 16) for a, b in ((i + 4, i + 12), (i + 12, i + 28), (i + 28, i + 36))) for i in range(0, len(body), 36)}


def test_printed_tables_subtract(spark, rows):
    """What two printed fingerprints leave, subtracted cell by cell, is the differing digests once in each third."""
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    third = fingerprints.CELLS // 3
    for r in fingerprints.compare_versions(documents).collect():
        left, right = read(r.fingerprint), read(r.edited_fingerprint)
        assert int(r.fingerprint[:8], 16) == 3 * len(pieces(texts[r.doc_id]))
        assert (left == right) == (r.near_edited == 1.0)
        sums = [[0, 0, 0] for _ in range(3)]
        for cell in left | right:
            (n, x, c), (m, y, d) = left.get(cell, (0, 0, 0)), right.get(cell, (0, 0, 0))
            total = sums[cell // third]
            total[0], total[1], total[2] = total[0] + n - m, total[1] ^ x ^ y, total[2] ^ c ^ d
        assert sums[0] == sums[1] == sums[2]
        assert 3 * sums[0][0] == int(r.fingerprint[:8], 16) - int(r.edited_fingerprint[:8], 16)


def test_an_id_on_all_rows_is_cut_into_ranges(spark):
    documents = spark.createDataFrame([(7, f"text {i}") for i in range(400)], "doc_id long, text string")
    bounds = fingerprints._bounds(documents, "doc_id", 8)
    assert len(bounds) == 7 and len({h for _, h in bounds}) == 7 and {d for d, _ in bounds} == {7}
    out = fingerprints.compare_versions(documents)
    assert out.count() == 400


def test_cells_must_divide_by_the_hashes(spark):
    with pytest.raises(ValueError):
        fingerprints.compare_versions(spark.createDataFrame([(1, "a")], "doc_id long, text string"), cells=10)
