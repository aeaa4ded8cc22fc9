"""What a Python worker keeps between batches and tasks is bounded, and results do not depend on it."""

import json

import pyarrow as pa
import public_tokenizers

from reviewlane.llm import bpe, similar, toxicity
from reviewlane.llm.common import sliced


def _coder(**options):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return bpe.WordBpe(json.load(f), **options)


def test_words_asked_for_once_are_forgotten():
    coder = _coder()
    for at in range(0, 250_000, 5_000):
        coder.encode_batch(["common " + " ".join("".join(chr(97 + i // 26**k % 26) for k in range(4)) + "zq" for i in range(at, at + 5_000))])
    assert len(coder.known) + len(getattr(coder.known, "aged", ())) <= 200_000
    guessed = coder.guessed
    coder.encode_batch(["common"])
    assert coder.guessed == guessed


def test_forgetting_changes_no_ids():
    texts = [f"the theory of word{i % 7} qx{i % 11}y thereof unthreaded{i}" for i in range(60)]
    whole, small = _coder(), _coder(words_kept=5)
    want = whole.encode_batch(texts)
    assert [small.encode_batch([t])[0] for t in texts] == want
    assert [small.encode_batch([t])[0] for t in reversed(texts)] == want[::-1]


def test_sliced_batches_are_small_and_whole():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (0, 1, 256, 600)]
    parts = list(sliced(iter(batches)))
    assert max(p.num_rows for p in parts) == 256
    assert [x for p in parts for x in p.column("x").to_pylist()] == [x for b in batches for x in b.column("x").to_pylist()]


def test_stages_return_small_batches(spark):
    """A stage gives its rows back in parts, not in one batch of Arrow's 10,000 rows."""
    made = []

    class Frame:
        """Stands for a DataFrame: takes the function that mapInArrow gets."""

        def __init__(self, df):
            self.df, self.columns, self.schema = df, df.columns, df.schema

        def mapInArrow(self, run, schema):
            made.append(run)
            return self.df

        def select(self, *columns):
            return self.df.select(*columns)

    rows = spark.createDataFrame([(1, "a few words of text")], "doc_id long, text string")
    model = toxicity.Model(b"", b"", b"", [], [], [], 0.25, 128)
    toxicity.score(Frame(rows), model, keep_text=True)
    similar.printed(Frame(rows))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1_000)), "text": ["a few words of text"] * 1_000})
    for run in made:
        parts = list(run(iter([batch])))
        assert max(p.num_rows for p in parts) <= 256
        assert [x for p in parts for x in p.column("doc_id").to_pylist()] == list(range(1_000))
