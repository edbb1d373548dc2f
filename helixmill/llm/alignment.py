"""Cross-tokenizer alignment by an event sweep.

Two tokenizers, A (byte-level BPE) and B (a piece model), cut the same bytes. Every token is an event at the byte where
it ends. Events of both are put together, dealt out by document, sorted by offset within partitions, and streamed
through a machine whose state is what has not been closed yet: where an A and a B event fall on the same byte, a group
closes; every event links the token that ends there with the other side's token that is open. Events travel packed, a
row for the tokens of one side that end within SPAN bytes; a token's length follows from its id, so a row holds ids only.

A pair's count is the number of documents that hold it linked. Counts are summed in workers before they are shuffled.
Documents meet the counts of their pairs in sorted arrays that are broadcast if a count allows, and in a join of rows
beyond that.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.shipping import ensure_shipped

from .common import lean, materialize, settled, small_enough
from .pieces import BYTE, META, codec, read_model

SPAN = 1 << 16
A, B, NONE = 0, 1, -1
#: Pair counts up to so many are broadcast, 17 bytes each.
PAIRS = 2_000_000
#: Pairs that a worker holds before it sums them, and bytes of rows that it passes on at a time.
HELD, PASSED = 1 << 21, 1 << 21
#: What a worker remembers of words that B has encoded.
CACHE_BYTES = 224 << 20


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_tokens(path: str | None = None) -> list[bytes]:
    """The bytes of each id of a byte-level BPE file, in id order, without its special tokens; ids are merge ranks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    special = {t["id"] for t in whole.get("added_tokens", ()) if t.get("special")}
    letters = byte_letters()
    found = {i: bytes(letters[c] for c in token) for token, i in whole["model"]["vocab"].items() if i not in special}
    if sorted(found) != list(range(len(found))):
        raise ValueError("only vocabularies whose special tokens come last are supported")
    return [found[i] for i in range(len(found))]


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=1)
def _byte_encoder(tokens: tuple[bytes, ...], pattern: str):
    import tiktoken

    return tiktoken.Encoding("byte level", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


#: White space, of which the byte tokenizer's pattern can't match runs of hundreds of thousands.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def encode_bytes(encoder, text: str) -> list[int]:
    """Ids of a text without special tokens. A long run of white space is one piece, but for its last character if text follows."""
    out: list[int] = []
    at = 0
    for run in LONG_SPACE.finditer(text):
        start, end = run.span()
        end -= end < len(text)
        out += encoder.encode_ordinary(text[at:start])
        out += encoder._encode_single_piece(text[start:end])
        at = end
    return out + encoder.encode_ordinary(text[at:]) if at else encoder.encode_ordinary(text)


def piece_bytes(model: bytes) -> list[bytes]:
    """The bytes of each piece: its text with U+2581 as a space, or the byte that it names."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    return [bytes([int(p.piece[3:-1], 16)]) if p.type == BYTE else p.piece.replace(META, " ").encode() for p in proto.pieces]


class Spelling:
    """The bytes of a vocabulary's tokens in one array, to spell many tokens at once."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def spells(self, ids: np.ndarray, ends: np.ndarray, raw: np.ndarray) -> bool:
        """Whether tokens that end at ``ends`` spell the bytes of a text."""
        if not len(ends) or ends[-1] != len(raw):
            return False
        lengths = self.lengths[ids]
        at = np.repeat(self.starts[ids] - ends + lengths, lengths)
        at += np.arange(len(raw))
        return bool((self.bytes[at] == raw).all())


def id_kind(*vocabularies: list[bytes]) -> np.dtype:
    return np.dtype("<u2" if max(map(len, vocabularies)) <= 1 << 16 else "<u4")


EVENTS = "row long, offset long, side int, start long, ids binary"


def _events(tokens: list[bytes], pattern: str, model: bytes):
    """(row, doc_id, text) -> packed end events of both tokenizers; one row of side NONE for a text without tokens."""
    kept = tuple(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, other, pieces = _byte_encoder(kept, pattern), codec(model, CACHE_BYTES), piece_bytes(model)
        kind = id_kind(kept, pieces)
        spelling = (Spelling(kept), Spelling(pieces))
        made: list[tuple] = []
        size = 0

        def passed() -> pa.RecordBatch:
            n, of, offset, side, start, ids = zip(*made)
            return pa.record_batch({"row": pa.array(n, pa.int64()), "doc_id": pa.array(of, batch.schema.field(1).type), "offset": pa.array(offset, pa.int64()), "side": pa.array(side, pa.int32()), "start": pa.array(start, pa.int64()), "ids": pa.array(ids, pa.binary())})

        for batch in batches:
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py()
                both = []
                if text:
                    raw = np.frombuffer(b" " + text.encode("utf-8"), np.uint8)
                    for side, ids in enumerate((np.frombuffer(array("I", encode_bytes(encoder, " " + text)), np.uintc), np.frombuffer(other.encode(text), "<u4")[1:-1])):
                        ends = np.cumsum(spelling[side].lengths[ids])
                        if spelling[side].spells(ids, ends, raw):
                            both.append((side, ids, ends))
                if len(both) < 2:
                    made.append((row, doc_id, 0, NONE, 0, b""))
                    continue
                for side, ids, ends in both:
                    first = np.flatnonzero(np.diff((ends - 1) // SPAN, prepend=-1))
                    for s, e in zip(first, [*first[1:], len(ids)]):
                        made.append((row, doc_id, int((ends[s] - 1) // SPAN), side, int(ends[s - 1]) if s else 0, ids[s:e].astype(kind).tobytes()))
                size += 2 * len(raw)
                if size >= PASSED:
                    yield passed()
                    made, size = [], 0
            if made:
                yield passed()
                made, size = [], 0

    return run


class Sweep:
    """The machine: takes the events of one document by offset; ``groups`` closed and ``pairs`` linked so far, and what is still open."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray]):
        self.lengths = lengths
        self.base = len(lengths[B])
        width = len(str(max(map(len, lengths)))) + 1
        shown = [f"{i}{mark}".encode() for side, marks in ((A, ",|"), (B, ",;")) for mark in marks for i in range(len(lengths[side]))]
        text = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in shown), np.uint8).reshape(-1, width)
        self.text, self.drawn = text, text > 0
        self.shift = (len(lengths[A]), 2 * len(lengths[A]), 2 * len(lengths[A]) + len(lengths[B]))
        self.reset()

    def reset(self) -> None:
        self.ids = [[], []]
        self.ends = [[], []]
        self.n = [0, 0]
        self.groups = 0
        self.sha = hashlib.sha256()
        self.linked: list[np.ndarray] = []

    def feed(self, side: int, start: int, ids: np.ndarray) -> None:
        self.ids[side].append(ids.astype(np.int64))
        self.ends[side].append(start + np.cumsum(self.lengths[side][ids]))
        self.n[side] += len(ids)

    def close(self) -> None:
        """Emit the groups and links up to the last byte where both sides end; the rest stays open."""
        if not (self.ids[A] and self.ids[B]):
            return
        (a, b), (a_end, b_end) = ([np.concatenate(x) if len(x) > 1 else x[0] for x in of] for of in (self.ids, self.ends))
        at = np.searchsorted(b_end, a_end)
        same = np.zeros(len(a), bool)
        inside = at < len(b)
        same[inside] = b_end[at[inside]] == a_end[inside]
        last_a = np.flatnonzero(same)
        if not len(last_a):
            self.ids, self.ends = [[a], [b]], [[a_end], [b_end]]
            return
        last_b = at[last_a]
        n, m = last_a[-1] + 1, last_b[-1] + 1
        self.ids, self.ends = ([[x[k:]] if k < len(x) else [] for x, k in zip(of, (n, m))] for of in ((a, b), (a_end, b_end)))
        a, b, k = a[:n], b[:m], len(last_a)
        alone = np.ones(m, bool)  # B events on a byte where no A token ends
        alone[last_b] = False
        alone = np.flatnonzero(alone)
        open_a = np.searchsorted(a_end, b_end[alone])
        self.linked += [a * self.base + b[at[:n]], a[open_a] * self.base + b[alone]]
        self._tell(a, b, last_a, last_b)
        self.groups += k

    def _tell(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> None:
        """Add the groups' ids as text to the digest."""
        before = np.concatenate([[0], last_b[:-1] + 1])
        out = np.zeros(len(a) + len(b), np.int64)
        mark_a, mark_b = np.zeros(len(a), np.int64), np.full(len(b), self.shift[1])
        mark_a[last_a], mark_b[last_b] = self.shift[0], self.shift[2]
        out[np.arange(len(a)) + np.repeat(before, np.diff(last_a, prepend=-1))] = a + mark_a
        out[np.arange(len(b)) + np.repeat(last_a + 1, np.diff(last_b, prepend=-1))] = b + mark_b
        raw = self.text[out][self.drawn[out]].tobytes()
        self.sha.update((b";" if self.groups else b"") + raw[:-1])

    def told(self) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links, the digest, the distinct pairs in order, and how often each is linked; all of the document is closed."""
        if not self.groups:
            empty = np.zeros(0, np.int64)
            return 0, 0, 0, 0, "", empty, empty
        pairs, times = np.unique(np.concatenate(self.linked), return_counts=True)
        return self.n[A], self.n[B], self.groups, int(times.sum()), self.sha.hexdigest(), pairs, times


def pack(pairs: np.ndarray, times: np.ndarray, base: int, press: zstandard.ZstdCompressor) -> bytes:
    """Sorted pairs and how often each comes, in few bytes."""
    if not len(pairs):
        return b""
    a, b = np.divmod(pairs, base)
    wide = np.uint8 if times.max() < 256 else np.uint32
    head = np.array([len(pairs), np.dtype(wide).itemsize], "<u4").tobytes()
    planes = [x.astype("<u4").view(np.uint8).reshape(-1, 4).T[:3].tobytes() for x in (np.diff(a, prepend=0), b)]
    return press.compress(head + b"".join(planes) + times.astype(wide).tobytes())


def unpack(raw: bytes, base: int, press: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    if not raw:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = press.decompress(raw)
    n, wide = np.frombuffer(raw, "<u4", 2)
    planes = np.frombuffer(raw, np.uint8, 6 * n, 8).reshape(2, 3, n).astype(np.int64)
    delta, b = planes[:, 0] | planes[:, 1] << 8 | planes[:, 2] << 16
    times = np.frombuffer(raw, np.uint8 if wide == 1 else np.uint32, n, 8 + 6 * int(n))
    return np.cumsum(delta) * base + b, times.astype(np.int64)


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _sweep(tokens: list[bytes], pieces: list[bytes]):
    """Sorted events -> (doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links), a row per document."""
    kind = id_kind(tokens, pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Sweep(tuple(np.fromiter(map(len, v), np.int64, len(v)) for v in (tokens, pieces)))
        press = zstandard.ZstdCompressor(level=3)
        made: list[tuple] = []
        now, part, size = None, -1, 0  # the document (row, doc_id) and the stretch of offsets that are read

        def passed(kind_of: pa.DataType) -> pa.RecordBatch:
            doc_id, *counts, sha, links = zip(*made)
            columns = {n: pa.array(c, pa.int64()) for n, c in zip(COUNTS, counts)}
            return pa.record_batch({"doc_id": pa.array(doc_id, kind_of), **columns, "groups_sha256": pa.array(sha, pa.string()), "links": pa.array(links, pa.binary())})

        def finish() -> int:
            machine.close()
            *digest, pairs, times = machine.told()
            made.append((now[1], *digest, pack(pairs, times, machine.base, press)))
            machine.reset()
            return 200 + len(made[-1][-1])

        of = None
        for batch in batches:
            of = batch.schema.field(1).type
            row, doc_id, offset, side, start = (batch.column(i).to_pylist() for i in range(5))
            for i, ids in enumerate(batch.column(5)):
                if now is None or row[i] != now[0]:
                    if now is not None:
                        size += finish()
                    now, part = (row[i], doc_id[i]), -1
                if offset[i] != part:
                    machine.close()
                    part = offset[i]
                if side[i] != NONE:
                    machine.feed(side[i], start[i], np.frombuffer(ids.as_py(), kind))
            if size >= PASSED:
                yield passed(of)
                made, size = [], 0
        if now is not None:
            finish()
            yield passed(of)

    return run


def _pair_counts(base: int):
    """(links) -> (pair, docs): pairs of many documents summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        held: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            pairs, docs = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch({"pair": pa.array(pairs), "docs": pa.array(docs.astype(np.int64))})

        n = 0
        for batch in batches:
            for raw in batch.column(0):
                held.append(unpack(raw.as_py(), base, press)[0])
                n += len(held[-1])
                if n >= HELD:
                    yield summed()
                    held, n = [], 0
        if n:
            yield summed()

    return run


def _judge(base: int, counts):
    """Swept documents -> n_best and count_sum, from broadcast arrays of the sorted pairs, their counts and whether each is its A id's best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        known, docs, best = counts.value
        for batch in batches:
            n_best, total = [], []
            for raw in batch.column("links"):
                pairs, times = unpack(raw.as_py(), base, press)
                at = np.searchsorted(known, pairs)
                n_best.append(int(times[best[at]].sum()))
                total.append(int((times * docs[at]).sum()))
            kept = {n: batch.column(n) for n in ("doc_id", *COUNTS)}
            yield pa.record_batch(kept | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64()), "groups_sha256": batch.column("groups_sha256")})

    return run


def _listed(base: int):
    """(row, links) -> (row, pair, times), a row per distinct pair of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                pairs, times = unpack(raw.as_py(), base, press)
                for start in range(0, len(pairs), HELD):
                    some = slice(start, start + HELD)
                    yield pa.record_batch({"row": pa.array(np.full(len(pairs[some]), row, np.int64)), "pair": pa.array(pairs[some]), "times": pa.array(times[some])})

    return run


def align(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, pattern: str | None = None, most_pairs: int = PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): a row per document.

    Both tokenizers cut a space and the text. A group ends where tokens of both end; tokens link whose bytes overlap.
    ``n_best`` counts the links whose pair is in as many documents as any pair of its A id, ``count_sum`` sums the
    documents of the links' pairs, ``groups_sha256`` digests the ids group by group.

    Defined cases: null and empty texts, and texts whose tokens don't spell a space and the text (one with U+2581, which B
    reads as a space), have no tokens: zeros and an empty digest; repeated rows are documents of their own, whatever
    their ids; very long texts are swept stretch by stretch; an empty table gives an empty result. Other columns are
    ignored.
    """
    return settled(docs.sparkSession, "aligned", lambda: _align(docs, byte_path, piece_path, pattern, most_pairs))


def swept_documents(docs: DataFrame, tokens: list[bytes], pattern: str, model: bytes) -> DataFrame:
    """(doc_id, counts, groups_sha256, links): events of both sides put together, dealt by document, sorted by offset, swept."""
    spark = docs.sparkSession
    ensure_shipped(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    events = rows.mapInArrow(lean(_events(tokens, pattern, model)), f"row long, doc_id {kind}, offset long, side int, start long, ids binary")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = events.repartition(tasks, "row").sortWithinPartitions("row", "offset", "side")
    columns = ", ".join(f"{n} long" for n in COUNTS)
    return sorted_.mapInArrow(lean(_sweep(tokens, piece_bytes(model))), f"doc_id {kind}, {columns}, groups_sha256 string, links binary")


def pair_documents(swept: DataFrame, base: int) -> DataFrame:
    """(pair, docs, best): in how many documents each pair is linked, and whether no pair of its A id is in more."""
    counted = swept.select("links").mapInArrow(lean(_pair_counts(base)), "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    counted = materialize(counted.withColumn("a", F.expr(f"pair div {base}")), "pairs")
    highest = counted.groupBy("a").agg(F.max("docs").alias("most"))
    return counted.join(highest, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _align(docs: DataFrame, byte_path: str | None, piece_path: str | None, pattern: str | None, most_pairs: int) -> DataFrame:
    spark = docs.sparkSession
    tokens, model = byte_level_tokens(byte_path), read_model(piece_path)
    base = len(piece_bytes(model))
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(f"{n} long" for n in COUNTS)
    swept = materialize(swept_documents(docs, tokens, pattern or default_pattern(), model), "swept")
    counts = materialize(pair_documents(swept, base), "pair_counts")
    if small_enough(counts, most_pairs):
        table = counts.toArrow().sort_by("pair")
        sent = spark.sparkContext.broadcast(tuple(table.column(n).to_numpy() for n in ("pair", "docs", "best")))
        return swept.mapInArrow(lean(_judge(base, sent)), f"doc_id {kind}, {columns}, n_best long, count_sum long, groups_sha256 string")
    numbered = materialize(swept.withColumn("row", F.monotonically_increasing_id()), "numbered")
    linked = numbered.select("row", "links").mapInArrow(lean(_listed(base)), "row long, pair long, times long").join(counts, "pair")
    judged = linked.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    of = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("n_best", "count_sum")]
    return numbered.join(judged, "row", "left").select("doc_id", *COUNTS, *of, "groups_sha256")
