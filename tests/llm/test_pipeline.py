"""Stages of the pipeline against brute force."""

import random
import re
from collections import Counter

import brute
import corpus_pipeline
import pytest

from reviewlane.llm import secrets, toxicity


def shingle_set(text, words=5):
    split = brute.SPACED.findall((text or "").translate(brute.LOW))
    return frozenset(tuple(split[i : i + words]) for i in range(max(1, len(split) - words + 1))) if split else frozenset()


def alike(a, b):
    return a == b or (len(a & b) >= 0.8 * len(a | b) and bool(a & b))


def survivors(rows):
    """Of each component the row least by id, null ids last; rows of equal id are told apart by their text."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                root[top(i)] = top(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(top(i), []).append(rows[i])
    return members.values()


def edited(words, n, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"edit{rng.randrange(10**9)}"
    return out


def corpus(copies):
    """Families of copies with 0 to 10 edits in 200 words, so with similarities from 1 to about 0.6."""
    rng, texts = random.Random(5), []
    for family in range(12):
        words = [f"f{family}w{rng.randrange(5000)}" for _ in range(200)]
        texts += [" ".join(words)] + [" ".join(edited(words, n % 11, rng)) for n in range(copies)]
    words = [f"large{i}" for i in range(300)]
    texts += [" ".join(edited(words, 3, rng)) for _ in range(60)]  # buckets longer than a run
    texts += ["", None, " \n", "one two", "One two", "one two three"]
    rng.shuffle(texts)
    return texts


@pytest.fixture
def documents(spark):
    return lambda rows: spark.createDataFrame(
        [(i, t, "en", "x", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )


def test_near_duplicates(spark, documents):
    rows = list(enumerate(corpus(11)))
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(rows), "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = [min(m) for m in survivors(rows)]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(want)
    assert corpus_pipeline.drop_near_duplicates(spark, documents(rows).limit(0), "").count() == 0


def test_near_duplicates_of_a_dense_group(spark, documents):
    """Copies with 2 to 5 edits in 120 words: their similarities lie around 0.8, so links are few and hidden among near pairs."""
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(i, " ".join(edited(words, rng.randrange(2, 6), rng))) for i in range(300)]
    groups = list(survivors(rows))
    assert 200 < len(groups) < 290
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, documents(rows), "").collect()}
    linked = [min(m)[0] for m in groups if len(m) > 1]
    assert set(linked) <= kept and len(kept) - len(groups) <= 0.05 * sum(len(m) - 1 for m in groups)


def test_near_duplicates_of_null_and_repeated_ids(spark, documents):
    rng = random.Random(6)
    texts = [" ".join(f"u{i}w{j}" for j in range(60)) for i in range(12)]
    near = lambda t: " ".join(edited(t.split(), 1, rng))
    rows = [(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:8]] + list(enumerate(texts[8:], 20))
    rows += [(None, near(texts[8])), (7, near(texts[9])), (7, texts[4]), (None, texts[0]), (None, near(texts[1])), (30, near(texts[2]))]
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, documents(rows), "").collect()]
    groups = list(survivors(rows))
    assert len(kept) == len(set(kept)) == len(groups) == 12
    for members in groups:
        (stays,) = set(kept) & set(members)
        assert (stays[0] is None, stays[0] or 0) == min((i is None, i or 0) for i, _ in members)


MASK = "[REDACTED]"


def redacted(text):
    """All rules' matches, or unions of those that overlap, replaced by the mask."""
    spans = sorted((m.start(), m.end()) for r in secrets.RULES for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least)
    out, at = "", 0
    for start, end in spans:
        if start >= at:
            out += text[at:start] + MASK
        at = max(at, end)
    return out + text[at:]


def test_whole_pipeline(spark, sf):
    """Every stage in turn, row by row, over a whole table."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    documents, labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    score = toxicity.fit(documents, labels).scorer()
    rows = [r for r in rows if score(r[1]) < 0.5]
    rows = [min(m) for m in survivors(rows)]
    judged = brute.contamination(rows, [tuple(r) for r in items.select("item_id", "text").collect()])
    rows = [r for r, j in zip(rows, judged) if not j[5]]
    rows = [(d, redacted(t or "")) for d, t in rows]
    want = Counter(brute.tokens(rows, public_tokenizers.path("word_bpe_49k.json")))
    got = corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(tuple(r) for r in got) == want


HOSTILE = ["_row", "_doc", "_secrets", "_own0", "row", "root", "found", "secrets", "score", "key", "node", "least", "h"]


def test_stages_on_hostile_rows(spark, sf):
    long = " ".join(f"w{i % 97}x{i}" for i in range(3000)) + " password: hunter2hunter2"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").select("text").first().text
    texts = [(1, None), (2, ""), (3, " \n"), (None, long), (None, long), (4, long + " more"), (5, item), (6, "token = abcdefgh12"), (6, "another text here"), (None, "a b")]
    docs = spark.createDataFrame(
        [(i, t, "en", "x", len(t or ""), *HOSTILE) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in HOSTILE)
    )
    kept = {name: stage(spark, docs, sf) for name, stage in corpus_pipeline.STAGES}
    found = {name: df.collect() for name, df in kept.items()}
    for name, rows in list(found.items())[:-1]:
        assert kept[name].columns == docs.columns
        assert all(r[n] == n for r in rows for n in HOSTILE)
    assert len(found["toxicity"]) == len(texts)
    assert Counter((r.doc_id, r.text) for r in found["near_duplicates"]) == Counter({(1, None): 1, (4, long + " more"): 1, (5, item): 1, (6, "token = abcdefgh12"): 1, (6, "another text here"): 1, (None, "a b"): 1})
    assert Counter((r.doc_id, r.text) for r in found["decontamination"]) == Counter(x for x in texts if x[1] != item)
    assert Counter((r.doc_id, r.text, r.n_chars) for r in found["secrets"]) == Counter((i, t if t is None else redacted(t), len(redacted(t or ""))) for i, t in texts)
    assert len(found["tokens"]) == len(texts)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
