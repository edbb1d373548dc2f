"""Secret scans: patterns, and a character convolutional network over every candidate and its surroundings.

Pattern matches (assign, access, hex) are findings as they stand. Candidates are all long tokens, mixed tokens and
values of assignments, whether a pattern covers them or not. The network, in numpy, reads each with the characters
around it, a token longer than its frame piece by piece. It learns from labelled findings: candidates inside pattern
matches against look-alikes that no pattern covers, of a bounded sample of documents. Findings also come with their
surroundings blanked, and in the surroundings of look-alikes, so that the token itself must tell.

Documents set aside, by a hash of their text, calibrate: a logistic curve turns the network's output into a probability,
and the threshold recalls at least ``recall`` of their findings with the fewest false alarms, none next to what gave it
away, since outside the patterns' reach there is no 'password=' to go by. Where few findings would be set aside, each
fourth of the documents is scored by a network that learned from the rest, and the network learns from all. Candidates that reach the threshold and lie in
no pattern match are findings of kind ``cnn``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .sampling import fit_logistic, sample_ids, sample_texts

KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", re.ASCII)
HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)
#: Candidates: tokens of 8 or more with a digit, of 12 or more without, and values of 6 or more behind a colon or equals sign.
TOKENS = re.compile(r"(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{8,}|[A-Za-z0-9+/_-]{12,})={0,2}", re.ASCII)
VALUES = re.compile(r"""[:=]\x20*["']?(?=([A-Za-z0-9+/_-]{6,}={0,2}))""", re.ASCII)
BEFORE, TOKEN, AFTER = 24, 48, 8
FRAME = BEFORE + TOKEN + AFTER
#: Printable ASCII, one class for all else, one for padding.
CLASSES = 97
FILTERS, WIDTH = 16, 5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern findings, by start, then by kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of all candidates, by start."""
    found = dict(m.span() for m in TOKENS.finditer(text))
    if ":" in text or "=" in text:
        found |= (m.span(1) for m in VALUES.finditer(text))
    return sorted(found.items())


def covered(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each span shares a character with a pattern finding; findings are by start."""
    if not base or not spans:
        return np.zeros(len(spans), bool)
    starts = np.array([s for s, _, _ in base])
    reach = np.r_[-1, np.maximum.accumulate([e for _, _, e in base])]
    start, end = np.array(spans).T
    return reach[np.searchsorted(starts, end)] > start


def frames(text: str, spans: list[tuple[int, int]], blank: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Character classes in and around each span, and the span's number; of a span longer than a frame, overlapping pieces."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) - 32
    kinds = np.full(len(raw) + 1, CLASSES - 1, np.uint8)  # the last place is padding
    kinds[:-1] = np.where((raw >= 0) & (raw < 95), raw, 95)
    n = np.array([1 if e - s <= TOKEN else 1 + -(-(e - s - TOKEN) // (TOKEN // 2)) for s, e in spans], np.int64)
    owner = np.repeat(np.arange(len(spans)), n)
    start, end = np.array(spans, np.int64).reshape(-1, 2)[owner].T
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.maximum(np.minimum(start + piece * (TOKEN // 2), end - TOKEN), start)
    stop = np.minimum(begin + TOKEN, end)
    at = np.full((len(owner), FRAME), -1, np.int64)
    at[:, BEFORE : BEFORE + TOKEN] = begin[:, None] + np.arange(TOKEN)
    at[:, BEFORE : BEFORE + TOKEN][at[:, BEFORE : BEFORE + TOKEN] >= stop[:, None]] = -1
    if not blank:
        at[:, :BEFORE] = np.maximum(begin[:, None] + np.arange(-BEFORE, 0), -1)
        at[:, BEFORE + TOKEN :] = stop[:, None] + np.arange(AFTER)
        at[at >= len(raw)] = -1
    return kinds[at], owner


@dataclass
class CharNet:
    """One convolution over characters, maximum and mean over places, one logistic unit, a calibration; some 60 KB."""

    table: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    curve: np.ndarray
    threshold: float

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Active filters per place, their pooled values and a last one, and the logistic unit's input."""
        places = FRAME - WIDTH + 1
        total = np.zeros((len(x), places, FILTERS), self.table.dtype) + self.bias
        for k in range(WIDTH):
            total += self.table[k][x[:, k : k + places]]
        active = np.maximum(total, 0)
        pooled = np.concatenate([active.max(axis=1), active.mean(axis=1), np.ones((len(x), 1), self.table.dtype)], axis=1)
        return active, pooled, pooled @ self.dense

    def raw(self, x: np.ndarray) -> np.ndarray:
        parts = [self.forward(x[i : i + 256])[2] for i in range(0, len(x), 256)]
        return np.concatenate(parts).astype(float) if parts else np.zeros(0)

    def score(self, x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Calibrated probability of each of n candidates, that of its best piece."""
        best = np.full(n, -np.inf)
        np.maximum.at(best, owner, self.raw(x))
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * best, -30, 30)))


def gradients(net: CharNet, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the weighted mean logistic loss by table, bias and dense."""
    places = FRAME - WIDTH + 1
    active, pooled, z = net.forward(x)
    error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(x)
    d_pooled = error[:, None] * net.dense[None, :]
    d_active = np.repeat(d_pooled[:, None, FILTERS : 2 * FILTERS] / places, places, axis=1)
    rows, cols = np.meshgrid(np.arange(len(x)), np.arange(FILTERS), indexing="ij")
    d_active[rows, active.argmax(axis=1), cols] += d_pooled[:, :FILTERS]
    d_active *= active > 0
    flat = d_active.reshape(-1, FILTERS)
    d_table = np.zeros_like(net.table)
    for k in range(WIDTH):
        at = x[:, k : k + places].reshape(-1)
        order = np.argsort(at, kind="stable")
        kinds, first = np.unique(at[order], return_index=True)
        d_table[k][kinds] = np.add.reduceat(flat[order], first, axis=0)
    return d_table, flat.sum(axis=0), pooled.T @ error


def train_net(x: np.ndarray, y: np.ndarray, examples: int = 40_000, batch: int = 128, rate: float = 0.01, decay: float = 0.1, seed: int = 7) -> CharNet:
    """Adam with weight decay on the logistic loss, classes weighted alike, over as many rounds of the rows as make up ``examples``."""
    rng = np.random.default_rng(seed)
    net = CharNet(rng.normal(0, 0.1, (WIDTH, CLASSES, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS + 1), np.array([0.0, 1.0]), 2.0)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    params = [net.table, net.bias, net.dense]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(-(-examples // len(x))):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            pick = order[at : at + batch]
            step += 1
            for i, g in enumerate(gradients(net, x[pick], y[pick], weight[pick])):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] -= rate * ((first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8) + decay * params[i])
    net.table, net.bias, net.dense = (p.astype(np.float32) for p in params)
    return net


@dataclass
class Labelled:
    """A candidate of the sample: its first frames with and without surroundings, and whether a pattern covers it."""

    plain: np.ndarray
    blanked: np.ndarray
    found: bool
    fold: int


def labelled_candidates(texts: list[str], per_class: int) -> list[Labelled]:
    """Candidates of the texts, equal ones once, of either class the ``per_class`` with the smallest hashes.

    Texts are dealt to FOLDS by their hash, so that copies of a text are on one side.
    """
    seen: dict[bytes, tuple[int, str, tuple[int, int], bool, int]] = {}
    for text in sorted(set(texts)):
        spans = candidates(text)
        fold = zlib.crc32(text.encode("utf-8", "surrogatepass")) % FOLDS
        for (s, e), found in zip(spans, covered(spans, base_spans(text)).tolist()):
            around = text[max(0, s - BEFORE) : e + AFTER].encode("utf-8", "surrogatepass") + bytes([found])
            seen.setdefault(around, (zlib.crc32(around, 7), text, (s, e), found, fold))
    out = []
    for found in (True, False):
        for _, text, (s, e), _, fold in sorted(c for c in seen.values() if c[3] == found)[:per_class]:
            low = max(0, s - BEFORE)
            near = text[low : e + AFTER]
            at = [(s - low, e - low)]
            out.append(Labelled(frames(near, at)[0][0], frames(near, at, blank=True)[0][0], found, fold))
    return out


def variants(rows: list[Labelled], cues: bool) -> tuple[np.ndarray, np.ndarray]:
    """Frames and classes: look-alikes as they stand or blanked by turns, findings blanked and in look-alikes' surroundings.

    With ``cues`` findings also come as they stand, next to what gave them away to the patterns.
    """
    found, others = [r for r in rows if r.found], [r for r in rows if not r.found]
    x = [r.blanked if i % 2 else r.plain for i, r in enumerate(others)]
    for i, r in enumerate(found):
        moved = others[i % len(others)].plain.copy() if others else r.blanked.copy()
        moved[BEFORE : BEFORE + TOKEN] = r.plain[BEFORE : BEFORE + TOKEN]
        x += [r.blanked, moved, *[r.plain] * cues]
    return np.stack(x), np.r_[np.zeros(len(others)), np.ones(len(x) - len(others))]


#: Folds of the documents; findings of either class at least; findings of the last fold with which it alone is set aside.
FOLDS, LEAST, ASIDE = 4, 4, 20


def train(texts: list[str], recall: float = 0.95, per_class: int = 4000) -> CharNet | None:
    """Net, calibration and threshold from labelled candidates.

    The last fold is set aside if it has ASIDE findings; else all folds take their turn, and the net learns from all.
    None if either class has fewer than LEAST candidates, or only one fold has findings.
    """
    rows = labelled_candidates(texts, per_class)
    n = sum(r.found for r in rows)
    if min(n, len(rows) - n) < LEAST:
        return None
    parts = [([r for r in rows if r.fold != k], [r for r in rows if r.fold == k]) for k in range(FOLDS)]
    parts = [(learn, held) for learn, held in parts if all(any(r.found for r in side) for side in (learn, held))]
    if not parts:
        return None
    alone = sum(r.found for r in rows if r.fold == FOLDS - 1) >= ASIDE and len(parts) > 1
    told = []
    for learn, held in parts[-1:] if alone else parts:
        net = train_net(*variants(learn, True))
        x, found = variants(held, False)
        told.append((net.raw(x), found))
    if not alone:
        net = train_net(*variants(rows, True))
    raw, found = (np.concatenate(x) for x in zip(*told))
    if 0 < found.sum() < len(found):
        net.curve = fit_logistic(raw[:, None], found, ridge=1e-3)
        net.curve[1] = max(net.curve[1], 1e-6)  # the curve keeps the order
    z = net.curve[0] + net.curve[1] * recall_threshold(raw[found == 1], raw[found == 0], recall)
    net.threshold = float(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return net


def recall_threshold(found: np.ndarray, others: np.ndarray, recall: float) -> float:
    """Of the thresholds that reach ``recall`` of ``found`` with the fewest of ``others``, about the lowest.

    Between the highest of ``others`` that stays out and the lowest of ``found`` above it nothing is known, so the
    threshold is halfway.
    """
    found = np.sort(found)
    most = found[int((1 - recall) * len(found))]
    out = others[others < most]
    if not len(out):
        return float(found[0])
    return float((out.max() + found[found > out.max()][0]) / 2)


def train_from_documents(docs: DataFrame, per_class: int = 1500) -> CharNet | None:
    """Learn from at most ``per_class`` documents with a pattern finding and as many without, chosen by a hash of the id."""
    pattern = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[a-z0-9+/_.=-]{6}|(?-i)AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
    marked = materialize(docs.select("doc_id", F.col("text").rlike(pattern).alias("found")), "marked")
    sample = sample_texts(docs, sample_ids(marked, "found", per_class, 2))
    return train([t for t, _ in sample])


def scan_texts(texts: list[str | None], net: CharNet | None) -> Iterator[tuple[list, list, int, int]]:
    """Per text: pattern spans, these and the network's, candidates scored, and candidates that reach the threshold."""
    held: list[tuple[list, list, np.ndarray]] = []
    parts: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    waiting = total = 0

    def flush() -> Iterator[tuple[list, list, int, int]]:
        scores = net.score(np.concatenate(parts), np.concatenate(owners), total) if parts else np.zeros(0)
        at = 0
        for base, spans, under in held:
            hit = scores[at : at + len(spans)] >= net.threshold if spans else np.zeros(0, bool)
            at += len(spans)
            more = [(*spans[i], 3) for i in np.flatnonzero(hit & ~under).tolist()]
            yield base, sorted(base + [(s, k, e) for s, e, k in more]) if more else base, len(spans), int(hit.sum())

    for text in texts:
        text = text or ""
        base = base_spans(text)
        spans = candidates(text) if net else []
        held.append((base, spans, covered(spans, base)))
        for start in range(0, len(spans), 4096):
            low, high = max(0, spans[start][0] - BEFORE), spans[min(start + 4096, len(spans)) - 1][1] + AFTER
            x, owner = frames(text[low:high], [(s - low, e - low) for s, e in spans[start : start + 4096]])
            parts.append(x)
            owners.append(owner + total)
            total += len(spans[start : start + 4096])
            waiting += len(x)
        if waiting >= 1 << 15:
            yield from flush()
            held, parts, owners, waiting, total = [], [], [], 0, 0
    yield from flush()


def find_secrets(docs: DataFrame, net: CharNet | None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_candidates, n_reached, status) of every whole text.

    ``n_candidates`` were scored and ``n_reached`` of them reach the threshold, those under a pattern too; ``status`` is
    'scored', or 'too few labelled findings' where there was nothing to learn a network from.

    Defined cases: a null text is empty and has no spans; spans that start together are ordered by kind; repeated rows
    get equal results; very long texts and tokens are read whole; without enough labelled findings only patterns count
    and nothing is scored; an empty input gives an empty result; other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(net)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], [], [], []]
        for base, spans, n, reached in scan_texts(batch.column(1).to_pylist(), shipped.value):
            row = (*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n, reached)
            for column, value in zip(out, row):
                column.append(value)
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
        names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_candidates", "n_reached")
        return pa.record_batch({"doc_id": batch.column(0), **{n: pa.array(v, t) for n, v, t in zip(names, out, kinds)}, "status": pa.array([status] * batch.num_rows, pa.string())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_candidates long, n_reached long, status string"
    status = "scored" if net else "too few labelled findings"
    return map_arrow(docs.select("doc_id", "text"), run, fields)
