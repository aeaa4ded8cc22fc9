"""Toxicity by compression distance with zstandard dictionaries.

zstandard trains two dictionaries from a bounded, documented sample of labelled rows: one of
toxic text and one of ordinary text. The toxic one is trained on the parts of toxic texts
that stand out - stretches of words whose byte n-grams are far more frequent there than in
ordinary texts - because whole toxic texts are mostly ordinary words, and a dictionary
trained on them tells the classes hardly apart. A text's words are cut into windows of
`window` bytes; each is compressed without a dictionary, with the toxic and with the
ordinary one. What the toxic dictionary saves, against none and against the ordinary one, is
the distance; the largest, mean and top savings are calibrated to a probability by logistic
regression on sample rows that no dictionary saw, and 0.5 is the threshold.

Defined results: null and empty texts have one empty window and are scored like any text;
a document with several labels is toxic if one says so; null labels are ignored; without
rows of both classes every score is the toxic share (0 without rows); rows are scored
independently, so repeated rows, null ids and other columns do not matter (one named as `out`
is replaced); a very long text is scored over all of its windows, but not learned from.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlane.llm.common import aside, own, restored, sliced

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
GRAMS = (4, 6, 8)  # bytes
FEATURES = 6
#: Ends each window, so that every one compresses and no saving is lost to raw blocks.
RULER = b" " * 64


def plain_words(text: str | None) -> list[bytes]:
    """Words of lower-case letters, digits and all non-ASCII characters."""
    return (text or "").encode().translate(_WORD_BYTES).split(b" ") if text else []


def _padded(text: str) -> list[bytes]:
    return [b" " + w + b" " for w in plain_words(text) if w]


def _grams(text: str) -> set[bytes]:
    return {w[i : i + n] for w in set(_padded(text)) for n in GRAMS for i in range(len(w) - n + 1)}


def standing_out(toxic: list[str], ordinary: list[str], least_z: float = 10.0, least_ratio: float = 5.0) -> set[bytes]:
    """Byte n-grams whose share of toxic texts is far above their share of ordinary ones."""
    a, b = Counter(), Counter()
    for texts, count in ((toxic, a), (ordinary, b)):
        for t in texts:
            count.update(_grams(t))
    na, nb = len(toxic), len(ordinary)
    # A word in a quarter of few toxic texts can't reach the usual bar, so the bar bends to the sample.
    best = 0.25 / math.sqrt(0.25 * na / (na + nb) * (1 / na + 1 / nb))
    least_z = min(least_z, 0.75 * best)
    found = set()
    for g, n in a.items():
        if n >= 5 and n / na >= least_ratio * (b[g] + 1) / nb:
            spread = math.sqrt((n + b[g] + 1) / (na + nb + 2) * (1 / na + 1 / nb))
            if (n / na - b[g] / nb) / spread >= least_z:
                found.add(g)
    return found


def _stretches(text: str, grams: set[bytes]) -> list[bytes]:
    """Maximal parts of words that the grams cover."""
    out = []
    for w in _padded(text):
        start = stop = -1
        for i in range(len(w) - GRAMS[0] + 1):
            for n in reversed(GRAMS):
                if w[i : i + n] in grams and i + n <= len(w):
                    if i > stop:
                        if stop > 0:
                            out.append(w[start:stop])
                        start = i
                    stop = max(stop, i + n)
                    break
        if stop > 0:
            out.append(w[start:stop])
    return out


def toxic_dictionary(toxic: list[str], ordinary: list[str], size: int = 4096) -> bytes:
    """A dictionary of up to `size` bytes trained on the standing-out stretches of the toxic texts; empty if none stands out."""
    grams = standing_out(toxic, ordinary)
    return _trained([s for t in toxic for s in _stretches(t, grams)], size)


def ordinary_dictionary(texts: list[str], size: int, window: int) -> bytes:
    """A dictionary trained on the windows of all texts."""
    bodies = (b" ".join(filter(None, plain_words(t))) for t in texts)
    return _trained([b[at : at + window] for b in bodies for at in range(0, len(b), window)], size)


def _trained(samples: list[bytes], size: int) -> bytes:
    """zstandard's dictionary of the samples; where they are too few for its trainer, they themselves, the commonest last."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        counts = Counter(samples)
        return b"".join(sorted(counts, key=lambda s: (counts[s], s)))[-size:]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    filler: bytes  # ordinary text, for texts too short to compress
    mean: list[float]
    scale: list[float]
    weights: list[float]
    prior: float
    window: int

    def scorer(self):
        """text -> probability; built once for each task."""
        if not self.weights:
            return lambda text: self.prior
        params = zstandard.ZstdCompressionParameters.from_level(
            9, min_match=5, target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=0, write_dict_id=0
        )
        dictionary = lambda x: zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        none = zstandard.ZstdCompressor(compression_params=params).compress
        tox = zstandard.ZstdCompressor(compression_params=params, dict_data=dictionary(self.toxic)).compress
        own = zstandard.ZstdCompressor(compression_params=params, dict_data=dictionary(self.ordinary[-len(self.toxic) :])).compress
        window, filler = self.window, self.filler

        def features(text: str | None) -> list[float]:
            body = b" " + b" ".join(filter(None, plain_words(text))) + b" "
            if len(body) < window // 2:  # too short to compress: filled up with ordinary text
                body += filler[: window - len(body)]
            saved, against = [], [0]
            for at in range(0, len(body), window):
                part = body[at : at + window] + RULER
                size = len(tox(part))
                saved.append(len(none(part)) - size)
                if saved[-1] > 0:
                    against.append(len(own(part)) - size)
            saved.sort(reverse=True)
            top = saved[:3]
            strong = sum(x - 2 for x in saved if x > 2)
            return [
                saved[0],
                max(against),
                sum(saved) / len(saved),
                sum(top) / len(top),
                math.log1p(strong),
                math.log1p(strong) / math.sqrt(len(saved)),
            ]

        mean, scale, weights = np.array(self.mean), np.array(self.scale), np.array(self.weights)

        def score(text: str | None) -> float:
            z = float(weights[0] + ((np.array(features(text)) - mean) / scale) @ weights[1:])
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

        score.features = features
        return score


def fit_rows(rows: list[tuple[str, int]], prior: float, window: int = 128) -> Model:
    """A model from sample rows (text, toxic); two of three rows make the dictionaries, the third calibrates."""
    model = Model(b"", b"", b"", [], [], [], prior, window)
    toxic, ordinary = ([t for t, label in rows if label == k] for k in (1, 0))
    if min(len(toxic), len(ordinary)) < 6:
        return model
    cut_t, cut_o = len(toxic) * 2 // 3, len(ordinary) * 2 // 3
    model.toxic = toxic_dictionary(toxic[:cut_t], ordinary[:cut_o])
    if len(model.toxic) < 8:
        return model
    model.filler = b" ".join(w for t in ordinary[:window] for w in plain_words(t) if w)[:window]
    model.ordinary = ordinary_dictionary(ordinary[:cut_o], max(1024, len(model.toxic)), window)
    model.mean, model.scale, model.weights = [0.0] * FEATURES, [1.0] * FEATURES, [0.0] * (FEATURES + 1)
    features = model.scorer().features
    x = np.array([features(t) for t in toxic[cut_t:] + ordinary[cut_o:]], dtype=float)
    y = np.array([1.0] * (len(toxic) - cut_t) + [0.0] * (len(ordinary) - cut_o))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    design = np.c_[np.ones(len(x)), (x - mean) / scale]
    # The sample holds more toxic rows than the corpus; weights bring its odds back to the corpus's.
    share = min(max(prior, 1e-3), 1 - 1e-3)
    each = np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum()) * len(y)
    weights, ridge = np.zeros(FEATURES + 1), np.diag([1e-6] + [0.05] * FEATURES)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        hessian = (design * (each * p * (1 - p))[:, None]).T @ design + ridge
        weights += np.linalg.solve(hessian, design.T @ (each * (y - p)) - ridge @ weights)
    model.mean, model.scale, model.weights = mean.tolist(), scale.tolist(), weights.tolist()
    return model


def fit(
    documents: DataFrame,
    labels: DataFrame,
    toxic_rows: int = 2250,
    ordinary_rows: int = 6750,
    longest: int = 20_000,
) -> Model:
    """Fit on at most toxic_rows and ordinary_rows distinct labelled texts of up to `longest` characters.

    Only rows with crc32(doc_id as text) mod 5 other than 0 are learned from. Which rows is
    settled by a hash of the id. The shares of labels are counted over all those rows.
    """
    judged = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    # The ids of usable rows, without their texts.
    usable = documents.where(F.length("text").between(1, longest)).select("doc_id", F.xxhash64("text").alias("h"))
    known = judged.join(usable, "doc_id").groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    counts = {r["toxic"]: r["n"] for r in judged.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    chosen = None
    for label, n in ((1, toxic_rows), (0, ordinary_rows)):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = F.broadcast(chosen.select("doc_id", "toxic", F.xxhash64("doc_id").alias("at"), "h"))  # at most toxic_rows + ordinary_rows
    texts = documents.select(F.col("doc_id").alias("_id"), "text")
    rows = texts.join(ids, (texts["_id"] == ids["doc_id"]) & (F.xxhash64("text") == ids["h"]))
    # Repeated rows become one before they leave the executors.
    single = rows.groupBy("at", "h").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    found = sorted((r["at"], r["text"], r["toxic"]) for r in single.collect())
    total = sum(counts.values())
    return fit_rows([(t, label) for _, t, label in found], counts.get(1, 0) / total if total else 0.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(documents: DataFrame, model: Model, text: str = "text", out: str = "score", keep_text: bool = False) -> DataFrame:
    """documents with `out`, the probability that the label is 1 (the text stays if keep_text)."""
    kept = [c for c in documents.columns if c != out and (keep_text or c != text)]
    schema = T.StructType([*(documents.schema[c] for c in kept), T.StructField(out, T.DoubleType())])

    def run(batches):
        scorer = model.scorer()
        for batch in sliced(batches):
            values = pa.array([scorer(x.as_py()) for x in batch.column(text)], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), values], [*kept, out])

    return documents.mapInArrow(run, schema)


def reject_toxic(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """documents that score below the threshold."""
    held = aside(documents)
    scored = score(held, model, own(documents, "text"), "score", keep_text=True)
    return scored.where(F.col("score") < threshold).select(*restored(scored, documents))
