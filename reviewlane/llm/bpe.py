"""BPE encoding and decoding by speculation and verification.

Each distinct word is first cut greedily by the longest vocabulary match. That guess is the
BPE result if and only if every adjacent pair of its tokens is compatible: no merge across
the boundary would have come before the merges that build the two tokens. Walking down the
right edge of the left token's merge tree and the left edge of the right token's, latest
merge first, visits every pair of parts that ever touch at the boundary; the pair is
incompatible if one of them is a merge that ranks before the merges that used up its parts.
This is tested for all pairs of a batch at once with NumPy. Only words with a failing pair
are merged exactly.

The reader of the vocabulary file follows its settings: NFC, white space runs to one space,
lower case by character, the pre-tokenizer's pattern, byte-level letters, `</w>` word ends,
and special tokens taken from the raw text first. Decoding joins the tokens as the file's
missing decoder asks: with one space.

Defined results: null and empty texts have no tokens; any length of text or word is
processed whole; rows are independent, so repeated rows, null ids and other columns do not
matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlane.llm.common import sliced, worker_cache

_NONE = -1


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A word-end BPE vocabulary with its merge trees as arrays by token id."""

    def __init__(self, spec: dict, words_kept: int = 100_000):
        model = spec["model"]
        if model["type"] != "BPE" or model["unk_token"] or model["byte_fallback"] or model["ignore_merges"]:
            raise ValueError("only plain BPE vocabularies are read")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for text, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = text
        # rank, left and right part of each token; -1 for single letters.
        self.rank, self.left, self.right = (np.full(size, _NONE, np.int64) for _ in range(3))
        self.merges: dict[int, tuple[int, int]] = {}  # pair as left * size + right -> rank, merged
        self.size = size
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if x * size + y not in self.merges:
                self.merges[x * size + y] = (rank, z)
                if self.rank[z] == _NONE:
                    self.rank[z], self.left[z], self.right[z] = rank, x, y
        pairs = sorted((key, rank) for key, (rank, _) in self.merges.items())
        self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in zip(*pairs))
        # Tokens that BPE itself makes of their own string; only these may be guessed.
        own = {t: i for t, i in self.vocab.items() if self.merged(self._letters(t)) == [i]}
        self.inner = {t: i for t, i in own.items() if not t.endswith(self.end) or not self.end}
        self.final = {t[: len(t) - len(self.end)]: i for t, i in own.items() if t.endswith(self.end)}
        self.longest = max(map(len, self.vocab))
        self.letters = byte_letters()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.marks = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.latin_words = re.compile(_latin_pattern(pattern))
        self.texts = {str(i): t for i, t in enumerate(self.strings)}
        self.known = _Known()
        self.words_kept = words_kept
        self.mark_start = os.path.commonprefix([*self.special])
        self.guessed = self.repaired = 0

    def _letters(self, token: str) -> list[int]:
        """Ids of a token's single letters, the last with the word end."""
        body = token[: len(token) - len(self.end)] if token.endswith(self.end) else token
        parts = list(body)
        if token.endswith(self.end) and parts:
            parts[-1] += self.end
        return [self.vocab[p] for p in parts] if all(p in self.vocab for p in parts) else []

    def merged(self, ids: list[int]) -> list[int]:
        """Exact merging, one pair at a time: the lowest rank first, leftmost first among equals.

        Pairs wait in a heap and tokens are a linked list, so long words cost n log n.
        """
        ids, size, n = list(ids), self.size, len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting = []

        def offer(i: int, j: int) -> None:
            found = self.merges.get(ids[i] * size + ids[j])
            if found:
                heapq.heappush(waiting, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while waiting:
            _, i, left, right, whole = heapq.heappop(waiting)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j], after[i] = whole, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [x for x in ids if x >= 0]

    def guess(self, word: str) -> list[int]:
        """Greedy longest match of a byte-level word."""
        out, at, n = [], 0, len(word)
        while at < n:
            whole = self.final.get(word[at:]) if n - at <= self.longest else None
            if whole is not None:
                out.append(whole)
                break
            for stop in range(min(n - 1, at + self.longest), at, -1):
                token = self.inner.get(word[at:stop])
                if token is not None:
                    out.append(token)
                    at = stop
                    break
            else:
                raise ValueError(f"no token for {word[at:]!r}")
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE keeps each pair (left[i], right[i]) of neighbouring tokens apart."""
        never = np.iinfo(np.int64).max
        a, b = left.copy(), right.copy()
        a_used, b_used = np.full(len(a), never), np.full(len(a), never)
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], never)
            # Of equal merges the leftmost comes first: inside the left token, then across.
            good[live[(rank < a_used[live]) & (rank <= b_used[live]) & (rank < never)]] = False
            rx, ry = self.rank[x], self.rank[y]
            go_a, go_b = live[rx > ry], live[(ry >= rx) & (ry >= 0)]
            a_used[go_a], a[go_a] = self.rank[a[go_a]], self.right[a[go_a]]
            b_used[go_b], b[go_b] = self.rank[b[go_b]], self.left[b[go_b]]
            live = live[good[live] & ((rx >= 0) | (ry >= 0))]
        return good

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of byte-level words: guess all, test all pairs at once, merge what fails."""
        guesses = [self.guess(w) for w in words]
        sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((i for g in guesses for i in g), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(guesses)), sizes)
        inside = owner[:-1] == owner[1:]
        bad = np.unique(owner[:-1][inside][~self.compatible(flat[:-1][inside], flat[1:][inside])])
        for i in bad.tolist():
            guesses[i] = self.merged([self.vocab[c] for c in words[i][:-1]] + [self.vocab[words[i][-1] + self.end]])
        self.guessed += len(words)
        self.repaired += len(bad)
        return guesses

    def split(self, text: str) -> list[str]:
        """The pre-tokenizer's words. White space parts words whatever its form, so it needs no rewriting."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # by character: no final sigma
            return self.words.findall(text)
        return self.latin_words.findall(text.lower())  # Latin-1 text is in NFC

    def _learn(self) -> None:
        """Encode the words that lookups missed."""
        known, table = self.known, self.letters
        fresh, known.missed = known.missed, {}
        if len(known) + len(fresh) > self.words_kept:
            known.age()
        words = list(fresh)
        coded = ["".join([table[b] for b in w.encode()]) for w in words]
        for word, ids in zip(words, self.encode_words(coded)):
            known[word] = text = " ".join(map(str, ids))
            fresh[word].append(text)

    def encode_batch(self, texts: list[str]) -> list[str]:
        """Token ids of each text, as decimals joined by one space."""
        found = []
        for text in texts:
            parts, at = [], 0
            for m in self.marks.finditer(text) if self.marks and self.mark_start in text else ():
                parts += map(self.known.__getitem__, self.split(text[at : m.start()]))
                parts.append(str(self.special[m.group()]))
                at = m.end()
            parts += map(self.known.__getitem__, self.split(text[at:]))
            found.append(parts)
        if self.known.missed:
            self._learn()
            found = [[x if x.__class__ is str else x[0] for x in parts] for parts in found]
        return [" ".join(parts) for parts in found]

    def decode(self, ids: str) -> str:
        return " ".join(map(self.texts.__getitem__, ids.split())) if ids else ""


class _Known(dict):
    """Word -> ids; a word that is missing gives a list that its ids will be put into.

    Most distinct words of a corpus come once, so what has not been asked for between two calls
    of `age` is forgotten: common words stay, and a worker, which outlives its tasks, holds little.
    """

    def __init__(self):
        super().__init__()
        self.missed: dict[str, list[str]] = {}
        self.aged: dict[str, str] = {}

    def __missing__(self, word: str) -> str | list[str]:
        if word in self.aged:
            self[word] = text = self.aged.pop(word)
            return text
        return self.missed.setdefault(word, [])

    def age(self) -> None:
        self.aged = dict(self)
        self.clear()


def _latin_pattern(pattern: str) -> str:
    r"""The pattern with \p{L}, \p{N} and \s written out for Latin-1, for the faster standard module."""

    def members(test) -> str:
        return "".join(re.escape(chr(c)) for c in range(256) if test(chr(c)))

    letters = members(lambda c: unicodedata.category(c)[0] == "L")
    numbers = members(lambda c: unicodedata.category(c)[0] == "N")
    spaces = members(lambda c: regex.match(r"\s", c))
    out = pattern.replace("[\\p{L}]", f"[{letters}]").replace("[\\p{N}]", f"[{numbers}]")
    return out.replace("\\p{L}", letters).replace("\\p{N}", numbers).replace("\\s", spaces)


def load_vocabulary(spark, path: str) -> str:
    """The vocabulary file's text, read through Spark or from the driver's own disk."""
    if "://" in path:
        return "\n".join(r.value for r in spark.read.text(path).collect())  # one vocabulary file
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """documents' other columns with n_tokens, ids_sha256 and decoded_sha256 (replaced if present)."""
    spark = documents.sparkSession
    held = spark.sparkContext.broadcast(load_vocabulary(spark, path))  # the vocabulary's size, not the data's
    added = ["n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [c for c in documents.columns if c not in (text, *added)]
    schema = T.StructType(
        [documents.schema[c] for c in kept]
        + [T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.StringType()) for c in added[1:])]
    )

    def digest(x: str) -> str:
        return hashlib.sha256(x.encode()).hexdigest()

    def run(batches):
        coder = worker_cache(f"bpe {path}", lambda: WordBpe(json.loads(held.value)))
        for part in sliced(batches, 64):
            ids = coder.encode_batch([x or "" for x in part.column(text).to_pylist()])
            columns = [
                pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64()),
                pa.array([digest(x) for x in ids]),
                pa.array([digest(coder.decode(x)) for x in ids]),
            ]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], [*kept, *added])

    return documents.select(*kept, text).mapInArrow(run, schema)


def encode(documents: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """documents with `out`: the array of token ids."""
    spark = documents.sparkSession
    held = spark.sparkContext.broadcast(load_vocabulary(spark, path))
    kept = [c for c in documents.columns if c != out]
    schema = documents.select(*kept, F.array().cast("array<int>").alias(out)).schema

    def run(batches):
        coder = worker_cache(f"bpe {path}", lambda: WordBpe(json.loads(held.value)))
        for batch in sliced(batches, 64):
            ids = coder.encode_batch([x or "" for x in batch.column(text).to_pylist()])
            values = pa.array([[int(i) for i in x.split()] for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), values], [*kept, out])

    return documents.select(*kept).mapInArrow(run, schema)
