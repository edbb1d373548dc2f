"""SentencePiece BPE encoding and decoding through a table of prefixes.

A byte-pair encoding has this property: the encoding of a text without its last token is the encoding of the remaining
prefix. So each prefix has a unique last token, and it is the one piece ending there that is compatible with the last
token of the prefix before it, that is, the two together encode to just these two. An Aho-Corasick automaton lists
the pieces that end at each position, tests of pairs are remembered, and the ids are read off the table backwards.
Which pairs merge follows from the vocabulary alone: two neighbours merge if their concatenation is a piece, the piece
of the highest score first, the leftmost first among equals.

Before that, a text is cut where no piece can reach across; chunks repeat, and what they encode to is remembered.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections import Counter
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

META = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NEVER = float("-inf")
CACHE_BYTES = 128 << 20
PAIR = 20  # bits of a piece id in the number of a pair


class Remembered(dict):
    """A dict that computes what it doesn't have and forgets all when it holds ``most`` bytes.

    ``weigh`` estimates the bytes of a key's entry; what weighs nothing is never kept.
    """

    def __init__(self, compute, weigh, most: int):
        super().__init__()
        self.compute, self.weigh, self.most, self.held = compute, weigh, most, 0

    def __missing__(self, key):
        made = self.compute(key)
        if weight := self.weigh(key):
            if self.held >= self.most:
                self.clear()
                self.held = 0
            self.held += weight
            self[key] = made
        return made


def weigh_chunk(chunk: str) -> int:
    """Bytes of a chunk and its ids in a dict; long chunks seldom come again and aren't kept."""
    return 200 + 5 * len(chunk) if len(chunk) <= 64 else 0


def weigh_pair(pair: int) -> int:
    """Bytes of a number and a truth value in a dict."""
    return 120


def apart(joined: set[str], pieces) -> tuple[set[str], set[str]]:
    """The characters that pieces join, letters and all that some piece joins to these, and the rest."""
    beside = {pair for piece in pieces for pair in zip(piece, piece[1:])}
    word = {c for c in joined if c.isalpha()}
    other = joined - word
    while moved := {c for c in other if any((c, x) in beside or (x, c) in beside for x in word)}:
        word, other = word | moved, other - moved
    return word, other


class PieceCodec:
    """Encoder and decoder of one model. What it remembers takes at most some ``cache_bytes``, a third for pairs."""

    def __init__(self, model: bytes, cache_bytes: int = CACHE_BYTES):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, train = proto.normalizer_spec, proto.trainer_spec
        kinds = {p.type for p in proto.pieces}
        if (
            train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or not norm.escape_whitespaces
            or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or train.treat_whitespace_as_suffix
            or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}
        ):
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no other normalisation are supported")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.names = [p.piece for p in proto.pieces]
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.byte_ids = [0] * 256
        self.surface: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                value = int(p.piece[3:-1], 16)
                self.byte_ids[value] = i
                self.surface.append(bytes([value]))
            elif p.type == CONTROL:
                self.surface.append(b"")
            elif p.type == UNKNOWN:
                self.surface.append(train.unk_surface.encode())
            else:
                self.surface.append(p.piece.replace(META, " ").encode())
        named = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == CONTROL}
        self.begin, self.end = named[train.bos_piece], named[train.eos_piece]
        longer = sorted((p for p in self.ids if len(p) > 1), key=lambda p: -self.scores[p])
        often = Counter(self.scores[p] for p in longer)
        #: How pieces begin that share their score with others, so that places decide between them.
        self.tied = {p[:2] for p in longer if often[self.scores[p]] > 1}
        #: When a piece is merged: characters are there from the start, then the highest score first.
        self.time = {p: i for i, p in enumerate([p for p in self.ids if len(p) == 1] + longer)}
        #: What each piece is merged from last.
        self.halves: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            made = self._merge(piece, stop=2)
            if len(piece) == 1 or len(made) == 2 and made[0] + made[1] in self.scores:  # else merges never produce it
                self.automaton.add_word(piece, (self.ids[piece], len(piece)))
                if len(piece) > 1:
                    self.halves[piece] = (made[0], made[1])
        self.automaton.make_automaton()
        joined = {c for piece in self.ids if len(piece) > 1 for c in piece} - {META}
        inside = any(META in piece.lstrip(META) for piece in self.ids)
        word, other = ("".join(map(re.escape, sorted(x))) or META for x in apart(joined, self.ids))
        #: Chunks that no piece reaches across: white space leads a chunk, words and punctuation are apart if no piece
        #: joins them, and a character of no longer piece stands alone.
        self.chunks = re.compile(f"(?s)[{META}{word}{other}]+|." if inside else f"(?s){META}+(?:[{word}]+|[{other}]+)?|[{word}]+|[{other}]+|.").findall
        self.compatible = Remembered(self._compatible_ids, weigh_pair, cache_bytes // 3)
        self.encoded = Remembered(self._encode_chunk, weigh_chunk, cache_bytes * 2 // 3)

    def _merge(self, text: str, border: int = 0, stop: int = 1) -> list[str]:
        """What merging the characters of a short text down to ``stop`` parts leaves; nothing if a merge reaches across the border."""
        parts, find = list(text), self.scores.get
        scores = [find(x + y, NEVER) for x, y in zip(parts, parts[1:])]
        while len(parts) > stop:
            best = max(scores)
            if best == NEVER:
                break
            at = scores.index(best)  # of equals the leftmost
            if at + 1 == border:
                return []
            if at + 1 < border:
                border -= 1
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = find(parts[at - 1] + parts[at], NEVER)
            if at < len(scores):
                scores[at] = find(parts[at] + parts[at + 1], NEVER)
        return parts

    def _compatible_ids(self, pair: int) -> bool:
        return self._compatible((self.names[pair >> PAIR], self.names[pair & (1 << PAIR) - 1]))

    def _compatible(self, pair: tuple[str, str]) -> bool:
        """Whether two pieces side by side stay as they are.

        Their last merges are undone one by one, the latest first; wherever the two pieces that then meet have a merge
        of their own that comes before what was undone, it would have been made instead.
        """
        a, b = pair
        time, halves = self.time, self.halves
        both = a + b
        if a not in time or b not in time or any(x in both for x in self.tied):  # a character that is no piece, or ties
            return len(self._merge(both, len(a))) == 2
        limit = len(time) + 1
        while True:
            if time.get(a + b, limit) < limit:
                return False
            if time[a] > time[b]:
                limit = time[a]
                if a in halves:
                    a = halves[a][1]
                    continue
                limit, whole = time[b] + 1, b
                b = halves[b][0] if b in halves else b
                if b == whole:
                    return True
            else:
                limit = time[b] + 1
                if b in halves:
                    b = halves[b][0]
                    continue
                limit, whole = time[a], a
                a = halves[a][1] if a in halves else a
                if a == whole:
                    return True

    def _encode_chunk(self, chunk: str) -> bytes:
        """Ids of a chunk as little-endian uint32."""
        last: list[int | None] = [None] * (len(chunk) + 1)  # by length of the prefix
        compatible, names, found = self.compatible, self.names, -1
        for end, (piece, length) in self.automaton.iter(chunk):
            if end == found:
                continue
            if start := end + 1 - length:
                before = last[start]
                if before is None:  # a character that is no piece
                    if not self._compatible((chunk[start - 1], names[piece])):
                        continue
                elif not compatible[before << PAIR | piece]:
                    continue
            last[end + 1] = piece
            found = end
        ids: list[int] = []
        at = len(chunk)
        while at:
            piece = last[at]
            if piece is None:  # a character that is no piece goes as its bytes
                ids.extend(self.byte_ids[b] for b in reversed(chunk[at - 1].encode("utf-8", "surrogatepass")))
                at -= 1
            else:
                ids.append(piece)
                at -= len(names[piece])
        packed = array("I", reversed(ids))
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a text with begin and end, as little-endian uint32."""
        body = b""
        if text:
            body = b"".join(map(self.encoded.__getitem__, self.chunks(META + text.replace(" ", META))))
        return self.begin.to_bytes(4, "little") + body + self.end.to_bytes(4, "little")

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of little-endian uint32 ids; bytes that are no UTF-8 become U+FFFD one by one."""
        raw = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        raw = raw[1:] if raw[:1] == b" " else raw
        try:
            raw.decode("utf-8")
        except UnicodeDecodeError:
            raw = re.sub("[\udc80-\udcff]", "�", raw.decode("utf-8", "surrogateescape")).encode("utf-8", "replace")
        return raw


@lru_cache(maxsize=1)
def codec(model: bytes, cache_bytes: int = CACHE_BYTES) -> PieceCodec:
    return PieceCodec(model, cache_bytes)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_model(path: str | None = None) -> bytes:
    """The model file's bytes, shipped with the tasks: a fixed half megabyte."""
    with open(path or default_model(), "rb") as f:
        return f.read()


def encode_digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per document.

    Defined cases: a null text is empty and has the begin and end ids only; repeated rows have equal digests; very long
    texts and words are encoded whole; an empty input gives an empty result; other columns are ignored.
    """
    model = read_model(model_path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, sha = codec(model), hashlib.sha256
        n, ids_sha, text_sha = [], [], []
        for text in batch.column(1):
            ids = own.encode(text.as_py())
            n.append(len(ids) // 4)
            ids_sha.append(sha(ids).hexdigest())
            text_sha.append(sha(own.decode(ids)).hexdigest())
        return pa.record_batch({"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_texts(docs: DataFrame, model_path: str | None = None, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """(doc_id, token_ids, decoded): the ids themselves and the text they decode to.

    Defined cases: those of ``encode_digests``; bytes that decode to no UTF-8 become U+FFFD one by one, as in the library.
    """
    model = read_model(model_path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(model, cache_bytes)
        coded = [own.encode(text.as_py()) for text in batch.column(1)]
        ids = pa.array([np.frombuffer(x, "<i4") for x in coded], pa.list_(pa.int32()))
        return pa.record_batch({"doc_id": batch.column(0), "token_ids": ids, "decoded": pa.array([own.decode(x).decode("utf-8", "replace") for x in coded], pa.string())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, token_ids array<int>, decoded string")
