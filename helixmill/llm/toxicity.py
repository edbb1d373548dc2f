"""Toxicity by compression distance: separate zstandard dictionaries for toxic and ordinary text.

A window of a text is compressed with either dictionary; the bytes that the toxic one saves show how much of the
window the toxic sample knows and the ordinary one doesn't. Both dictionaries start with the same content, trained on
words that both samples use, so that it cancels out; behind it each holds content trained on words whose stems are
far more usual in documents of its own class. The savings of a document's windows give a few features,
and a logistic curve, fitted on features from dictionaries that haven't seen the document and weighted by the share of
toxic documents among all labels, turns these into a calibrated score.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, map_arrow, packed
from .sampling import fit_logistic, sample_ids, sample_texts

WINDOW = 96
LEVEL = 6
MIN_MATCH = 5
SHARED_BYTES, OWN_BYTES = 1 << 18, 3072
#: Bytes of a word that tell its stem.
STEM = 5
LEAST_SHARE, LEAST_RATIO, LEAST_DEVIATIONS = 0.04, 3, 5
#: Content of a trained dictionary that is a header with entropy tables.
HEADER = 400
N_FEATURES = 5
#: Documents whose calibrated probability of being toxic reaches this are toxic.
TOXIC_FROM = 0.3


def windows(text: str | None) -> list[bytes]:
    """Runs of whole words of at least 96 bytes (the last may be shorter), each between spaces."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    out, start, base = [], 0, 0
    while start < len(words):
        end = min(int(np.searchsorted(ends, base + WINDOW)) + 1, len(words))
        out.append(b" %b " % b" ".join(words[start:end]))
        start, base = end, int(ends[end - 1])
    return out


@dataclass
class ToxicModel:
    """Dictionaries, scaling and logistic weights; some 520 KB whatever the corpus."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base_rate: float


def _content(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """Content of a dictionary trained on samples; too few samples to train on are the content themselves."""
    try:
        raw = zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()[HEADER:]
    except zstandard.ZstdError:
        raw = b""
    if len(raw) < (size - HEADER) // 2:
        raw = b"".join(samples)
    return raw[-size:].rjust(size, b"\0")


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=2 * WINDOW, dict_size=len(content), min_match=MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)


def marked_stems(seen: list[Counter], sizes: list[int], own: int) -> set[bytes]:
    """Stems that mark a class: in at least 4 % of its documents, three times the other's share, five deviations apart."""
    out = set()
    for stem, n in seen[own].items():
        other = seen[1 - own].get(stem, 0)
        share, rest, mean = n / sizes[own], other / sizes[1 - own], (n + other) / sum(sizes)
        spread = math.sqrt(mean * (1 - mean) * (1 / sizes[0] + 1 / sizes[1]))
        if n >= 3 and share >= LEAST_SHARE and share >= LEAST_RATIO * rest and share - rest >= LEAST_DEVIATIONS * spread:
            out.add(stem)
    return out


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Dictionaries for toxic and ordinary text; words are told apart by their first five bytes, so that a stem counts with all its endings."""
    split = [[t.lower().encode("utf-8", "surrogatepass").split() for t in texts] for texts in (toxic, ordinary)]
    seen = []
    for docs in split:
        stems: Counter = Counter()
        for words in docs:
            stems.update({w[:STEM] for w in words})
        seen.append(stems)
    marked = [marked_stems(seen, [len(toxic), len(ordinary)], i) for i in (0, 1)]

    def sample(docs, keep) -> list[bytes]:
        kept = ([w for w in words if keep(w[:STEM])] for words in docs)
        return [b" %b " % b" ".join(words) for words in kept if words]

    shared = _content(sample(split[1], lambda w: w in seen[0] and w not in marked[0] and w not in marked[1]), SHARED_BYTES, 32, 8)
    own = [_content(sample(split[i], lambda w, i=i: w in marked[i]), OWN_BYTES, 10, 6) for i in (0, 1)]
    return shared + own[0], shared + own[1]


class Scorer:
    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(toxic).compress, _compressor(ordinary).compress

    def features(self, text: str | None) -> np.ndarray:
        """Mean saving per window, largest, mean of the largest three and of the largest tenth, share of 4 or more bytes."""
        found = windows(text)
        if not found:
            return np.zeros(N_FEATURES)
        saved = np.fromiter((len(self.ordinary(w)) - len(self.toxic(w)) for w in found), float, len(found))
        top = np.sort(saved)[::-1]
        return np.array([saved.mean(), top[0], top[:3].mean(), top[: max(1, len(top) // 10)].mean(), (saved >= 4).mean()])


def train(learn: list[tuple[str, int]], base_rate: float, folds: int = 3) -> ToxicModel:
    """Fit on (text, 0 or 1). Each fold's features come from dictionaries of the other folds; the final ones use all."""
    classes = [[t for t, y in learn if y == c] for c in (1, 0)]
    if min(map(len, classes)) < folds:
        none = np.zeros(N_FEATURES)
        return ToxicModel(b"", b"", none, none + 1, np.zeros(N_FEATURES + 1), base_rate)
    rows, marks = [], []
    for fold in range(folds):
        scorer = Scorer(*train_dictionaries(*([t for i, t in enumerate(c) if i % folds != fold] for c in classes)))
        for texts, y in zip(classes, (1, 0)):
            apart = texts[fold::folds]
            rows += map(scorer.features, apart)
            marks += [y] * len(apart)
    x, y = np.array(rows), np.array(marks, float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    share = y.mean()
    weight = np.where(y == 1, base_rate / share, (1 - base_rate) / (1 - share))
    return ToxicModel(*train_dictionaries(*classes), mean, scale, fit_logistic((x - mean) / scale, y, weight), base_rate)


@lru_cache(maxsize=2)
def _scorer(toxic: bytes, ordinary: bytes) -> Scorer:
    return Scorer(toxic, ordinary)


def score_text(model: ToxicModel, text: str | None) -> float:
    """Probability that a text is toxic; without words, the share of toxic documents among the labels."""
    if not model.weights.any():
        return model.base_rate
    x = _scorer(model.toxic, model.ordinary).features(text)
    if not (text and text.strip(" \t\n\v\f\r")):
        return model.base_rate
    z = model.weights[0] + ((x - model.mean) / model.scale) @ model.weights[1:]
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train_from_labels(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int | None = None, per_class: int = 2500) -> ToxicModel:
    """Learn from labelled rows, but none of a held-out fold; at most ``per_class`` of each class, chosen by a hash of the id."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if held is not None:
        known = known.filter(crc_bucket(F.col("doc_id"), folds) != held)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = dict(tuple(r) for r in known.groupBy("toxic").count().collect())
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    return train(sample_texts(docs, sample_ids(known, "toxic", per_class, 2)), rate)


def score_documents(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, score) of every whole text.

    Defined cases: null, empty and white-space texts score the share of toxic labels; ties and repeated rows score
    alike; without labels of both classes every score is that share (0 without labels); other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shipped.value
        scores = [score_text(own, t.as_py()) for t in batch.column(1)]
        return pa.record_batch({"doc_id": batch.column(0), "score": pa.array(scores, pa.float64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")


def keep_ordinary(docs: DataFrame, model: ToxicModel, threshold: float) -> DataFrame:
    """The documents that score below the threshold, all columns as they are, whatever their names.

    Defined cases: those of ``score_documents``; an empty input gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    whole = docs.select(packed(docs))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shipped.value
        kept = [score_text(own, t.as_py()) < threshold for t in batch.column(0).field("text")]
        return batch.filter(pa.array(kept, pa.bool_()))

    return map_arrow(whole, run, whole.schema).select("own.*")
