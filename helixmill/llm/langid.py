"""Language identification by interpolated Kneser-Ney character models.

Each language has an n-gram model over letters; runs of anything else count as one space. The probabilities of all
languages sit side by side in arrays sorted by n-gram hash, one array per order: an n-gram that some language has seen
has its interpolated log probability in every language, and a context has its back-off weights. A text takes the
language of the lowest cross-entropy per character; a logistic curve over the margin to the next language gives the
score, and texts whose best cross-entropy is beyond nearly all calibration texts are marked as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, map_arrow
from .sampling import fit_logistic, sample_ids, sample_texts

ORDER = 4
#: Odd multiplier of the rolling n-gram hash.
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Characters scored at a time.
CHUNK = 1 << 18
SPACE = np.uint32(32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def normal_codes(text: str | None) -> np.ndarray:
    """Lower-case letters with one space for each run of others, led by the spaces of the first context; empty without letters."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[raw]
    if not letter.any():
        return np.zeros(0, np.uint32)
    codes = np.where(letter, raw, SPACE)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = codes[keep]
    lead = ORDER - 1 if codes[0] != SPACE else ORDER - 2
    return np.concatenate([np.full(lead, SPACE, np.uint32), codes])


def gram_keys(codes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the 1..ORDER-grams that end at each position; the first positions hold shorter contexts than they should."""
    one = codes.astype(np.uint64) + np.uint64(1)
    keys = [one]
    for _ in range(ORDER - 1):
        longer = one.copy()
        longer[1:] += keys[-1][:-1] * PRIME
        keys.append(longer)
    return keys


@dataclass
class LanguageModel:
    """Sorted hash arrays per order, with a column per language. Size is bounded by the sample."""

    languages: list[str]
    keys: list[np.ndarray]
    contexts: list[np.ndarray]
    logp: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray
    margin: np.ndarray
    reject_above: float


def _counts(texts: list[str], order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per order: the distinct n-grams' keys, context keys and suffix keys, and the counts of the highest order."""
    grams: list[list[np.ndarray]] = [[] for _ in range(order)]
    for text in texts:
        codes = normal_codes(text)
        if len(codes) < order:
            continue
        keys = gram_keys(codes)
        at = np.arange(order - 1, len(codes))
        for n in range(1, order + 1):
            context = keys[n - 2][at - 1] if n > 1 else np.zeros(len(at), np.uint64)
            suffix = keys[n - 2][at] if n > 1 else np.zeros(len(at), np.uint64)
            grams[n - 1].append(np.stack([keys[n - 1][at], context, suffix], axis=1))
    out = []
    for rows in grams:
        if not rows:
            out.append((np.zeros((0, 3), np.uint64), np.zeros(0)))
            continue
        every = np.concatenate(rows)
        _, first, count = np.unique(every[:, 0], return_index=True, return_counts=True)
        out.append((every[first], count.astype(float)))
    return out


def _lookup(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each asked key in the sorted keys, and whether it is there."""
    place = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
    return place, (keys[place] == asked if len(keys) else np.zeros(len(asked), bool))


def train(samples: dict[str, list[str]]) -> LanguageModel:
    """Fit on texts by language: four fifths of each are counted, the rest calibrates score and rejection."""
    languages = sorted(samples)
    cuts = {x: max(1, len(samples[x]) * 4 // 5) for x in languages}
    counted = [_counts(samples[x][: cuts[x]], ORDER) for x in languages]
    keys, contexts, logp, backoff = [], [], [], []
    vocabulary = max(1, len(np.unique(np.concatenate([c[0][0][:, 0] for c in counted])))) if languages else 1
    floor = np.full(len(languages), -np.log(vocabulary + 1.0))
    for n in range(1, ORDER + 1):
        union = np.unique(np.concatenate([c[n - 1][0][:, 0] for c in counted])) if languages else np.zeros(0, np.uint64)
        origin = np.zeros((len(union), 3), np.uint64)
        for grams, _ in (c[n - 1] for c in counted):
            origin[np.searchsorted(union, grams[:, 0])] = grams
        table = np.zeros((len(union), len(languages)), np.float64)
        # The spaces that lead a text are contexts, but end no n-gram.
        context_keys = np.unique(origin[:, 1]) if n > 1 else np.zeros(1, np.uint64)
        weights = np.zeros((len(context_keys), len(languages)))
        for at, language in enumerate(counted):
            grams, count = language[n - 1]
            if n < ORDER:  # Kneser-Ney: in how many ways a lower-order n-gram is continued to the left
                higher = language[n][0]
                place, there = _lookup(grams[:, 0], higher[:, 2])
                count = np.bincount(place[there], minlength=len(grams)).astype(float)
            once, twice = float((count == 1).sum()), float((count == 2).sum())
            discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
            place, _ = _lookup(context_keys, grams[:, 1])
            total = np.bincount(place, weights=count, minlength=len(context_keys))
            kinds = np.bincount(place, weights=(count > 0).astype(float), minlength=len(context_keys))
            gamma = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            weights[:, at] = gamma
            lower = np.full(len(union), np.exp(floor[at]))
            if n > 1:
                suffix, _ = _lookup(keys[n - 2], origin[:, 2])
                lower = np.exp(logp[n - 2][suffix, at])
            where_context, _ = _lookup(context_keys, origin[:, 1])
            own = np.zeros(len(union))
            mine = np.searchsorted(union, grams[:, 0])
            own[mine] = np.maximum(count - discount, 0) / np.maximum(total[place], 1)
            table[:, at] = np.log(np.maximum(own + gamma[where_context] * lower, 1e-12))
        keys.append(union)
        contexts.append(context_keys)
        logp.append(table.astype(np.float32))
        backoff.append(np.log(np.maximum(weights, 1e-12)).astype(np.float32))
    model = LanguageModel(languages, keys, contexts, logp, backoff, floor.astype(np.float32), np.array([0.0, 8.0]), float("inf"))
    rest = [(t, i) for i, x in enumerate(languages) for t in (samples[x][cuts[x] :] or samples[x])]
    entropy = cross_entropies(model, [t for t, _ in rest])
    usable = np.isfinite(entropy).all(axis=1) if len(rest) else np.zeros(0, bool)
    truth = np.array([i for _, i in rest], np.int64)[usable]
    entropy = entropy[usable]
    if len(entropy):
        model.reject_above = float(np.quantile(entropy[np.arange(len(truth)), truth], 0.999) * 1.1)
        if len(languages) > 1:
            best = np.argmin(entropy, axis=1)
            margins = np.stack([_margin(entropy, np.full(len(best), i)) for i in range(len(languages))], axis=1)
            hit = (np.arange(len(languages))[None, :] == truth[:, None]).astype(float)
            model.margin = fit_logistic(margins.reshape(-1, 1), hit.reshape(-1))
    return model


def _margin(entropy: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """By how much the best other language is worse than the chosen one."""
    others = entropy.copy()
    others[np.arange(len(chosen)), chosen] = np.inf
    return others.min(axis=1) - entropy[np.arange(len(chosen)), chosen]


def log_probabilities(model: LanguageModel, codes: np.ndarray) -> np.ndarray:
    """Log probability in each language of each position, from its longest known n-gram and the back-off weights."""
    keys = gram_keys(codes)
    out = np.zeros((len(codes), len(model.languages)), np.float32)
    left = np.arange(len(codes))
    for n in range(ORDER, 0, -1):
        place, there = _lookup(model.keys[n - 1], keys[n - 1][left])
        out[left[there]] += model.logp[n - 1][place[there]]
        left = left[~there]
        if not len(left):
            return out
        if n > 1:
            before = np.maximum(left - 1, 0)
            place, there = _lookup(model.contexts[n - 1], keys[n - 2][before])
            out[left[there]] += model.backoff[n - 1][place[there]]
        else:
            out[left] += model.backoff[0][0] + model.floor
    return out


def cross_entropies(model: LanguageModel, texts: list[str | None]) -> np.ndarray:
    """Cross-entropy per character of each text in each language; infinite for texts without a letter."""
    sums = np.zeros((len(texts), len(model.languages)))
    sizes = np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    owners: list[int] = []
    lead = ORDER - 1

    def flush() -> None:
        if not held:
            return
        values = log_probabilities(model, np.concatenate(held))
        starts = np.cumsum([0, *map(len, held)])
        scored = np.ones(len(values), bool)
        for s in range(lead):
            scored[starts[:-1] + s] = False
        values[~scored] = 0
        np.add.at(sums, np.array(owners), np.add.reduceat(values, starts[:-1], axis=0, dtype=np.float64))
        np.add.at(sizes, np.array(owners), np.diff(starts) - lead)
        held.clear()
        owners.clear()

    waiting = 0
    for i, text in enumerate(texts):
        codes = normal_codes(text)
        for start in range(0, max(len(codes) - lead, 0), CHUNK):
            piece = codes[start : start + CHUNK + lead]
            held.append(piece)
            owners.append(i)
            waiting += len(piece)
            if waiting >= CHUNK:
                flush()
                waiting = 0
    flush()
    return np.where(sizes[:, None] > 0, -sums / np.maximum(sizes, 1)[:, None], np.inf)


def train_from_documents(docs: DataFrame, folds: int = 5, held: int = 0, per_language: int = 300) -> LanguageModel:
    """Learn from labelled documents outside the held-out fold: all languages, at most ``per_language`` of each, fewer if there are over 200."""
    known = docs.filter(F.col("lang").isNotNull() & (crc_bucket(F.col("doc_id"), folds) != held))
    languages = known.select("lang").distinct().count()
    per_language = min(per_language, max(10, 200 * per_language // max(1, languages)))
    samples: dict[str, list[str]] = {}
    for text, lang in sample_texts(docs, sample_ids(known, "lang", per_language)):
        if len(normal_codes(text)) >= ORDER:
            samples.setdefault(lang, []).append(text)
    return train(samples)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every whole text.

    Defined cases: ``und`` with score 0 for null texts, texts without a letter, and all texts if nothing was learned;
    of languages that tie the first by code point; repeated rows get the same answer; other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shipped.value
        n = batch.num_rows
        names, scores, rejected = ["und"] * n, np.zeros(n), np.ones(n, bool)
        if own.languages:
            entropy = cross_entropies(own, batch.column(1).to_pylist())
            known = np.flatnonzero(np.isfinite(entropy[:, 0]))
            best = np.argmin(entropy[known], axis=1)
            margin = np.minimum(_margin(entropy[known], best), 1e3) if len(known) else np.zeros(0)
            scores[known] = 1 / (1 + np.exp(-np.clip(own.margin[0] + own.margin[1] * margin, -30, 30)))
            rejected[known] = entropy[known, best] > own.reject_above
            for i, b in zip(known.tolist(), best.tolist()):
                names[i] = own.languages[b]
        return pa.record_batch({"doc_id": batch.column(0), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores), "rejected": pa.array(rejected)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
