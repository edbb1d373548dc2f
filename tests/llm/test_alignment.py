"""Tokenizer alignment against a plain version with the libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from helixmill.llm import alignment

DOCS = "doc_id bigint, text string, row string, links string"


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain(libraries, rows):
    """Each row's result, from token spans compared one by one."""
    a, b = libraries
    letters = alignment.byte_letters()
    spell_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def spans(parts):
        ends = np.cumsum([0, *map(len, parts)])
        return list(zip(ends[:-1], ends[1:]))

    told, held = [], Counter()
    for _, text in rows:
        raw = b" " + (text or "").encode()
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        px, py = [spell_a(i) for i in x], [spell_b(i) for i in y]
        if not text or b"".join(px) != raw or b"".join(py) != raw:
            told.append(None)
            continue
        sx, sy = spans(px), spans(py)
        cuts = sorted({e for _, e in sx} & {e for _, e in sy})
        groups = []
        for s, e in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(i) for i, (f, t) in zip(ids, sp) if s <= f and t <= e) for ids, sp in ((x, sx), (y, sy))))
        linked = [(i, j) for i, (s, e) in zip(x, sx) for j, (f, t) in zip(y, sy) if f < e and s < t]
        held.update(set(linked))
        told.append((len(x), len(y), len(groups), linked, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return [
        (doc_id, 0, 0, 0, 0, 0, 0, "") if t is None else (doc_id, *t[:3], len(t[3]), sum(held[p] == most[p[0]] for p in t[3]), sum(held[p] for p in t[3]), t[4])
        for (doc_id, _), t in zip(rows, told)
    ]


EDGE = [None, "", " ", "a", "a▁b", "日本語 \U0001f600 <|endoftext|> <s>\n\n  \t x", "x" * 300 + " " * 300 + "é" * 300, "́  　 a\x00b", "The The", "The The", "don't  stop-it"]


@pytest.mark.parametrize("most_pairs", [alignment.PAIRS, 0])
def test_against_spans(spark, libraries, most_pairs):
    rng = random.Random(3)
    words = ["the", "Quelle", "straße", "word", "42,", "été", "don't", "\n", "\t", "日本", "(x)", "http://a.b/c", "antidisestablishment", "—"]
    texts = [*EDGE, *(rng.choice(["", " "]) + " ".join(rng.choices(words, k=rng.randrange(60))) for _ in range(60))]
    rows = list(enumerate(texts)) + [(5, "The The"), (None, "no id"), (1, "one id, other text")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    got = alignment.align(docs, most_pairs=most_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(libraries, rows)))


def test_long_texts_are_swept_stretch_by_stretch(spark, libraries):
    rng = random.Random(4)
    long = " ".join("".join(rng.choices("abcdeéß", k=rng.randrange(1, 9))) for _ in range(40_000))
    unbroken = "é" * 50_000 + " " * 70_000 + "x" * 70_000
    docs = spark.createDataFrame([(1, long, "", ""), (2, unbroken, "", "")], DOCS)
    got = {r.doc_id: r for r in alignment.align(docs).collect()}
    a, b = libraries
    for doc_id, text in ((1, long), (2, unbroken)):
        row = got[doc_id]
        assert (row.n_a, row.n_b) == (len(a.encode(" " + text, add_special_tokens=False).ids), len(b.encode(text)))
        assert row.n_links == row.n_a + row.n_b - row.n_groups


def test_long_runs_of_white_space(libraries):
    encoder = alignment._byte_encoder(tuple(alignment.byte_level_tokens()), alignment.default_pattern())
    for text in (" " * 12000 + "x", "a" + " " * 12000, "a" + "\n" * 12000 + "b", " \t\n" * 5000 + "word x", "a " + "　" * 11000 + " end", " " * 12000 + "\nx" + " " * 10001 + "'s", "\x1c" * 12000 + "a"):
        assert alignment.encode_bytes(encoder, " " + text) == libraries[0].encode(" " + text, add_special_tokens=False).ids
    assert len(alignment.encode_bytes(encoder, " " * 1_000_000)) > 0  # too long a run for the pattern


def test_the_machine_closes_groups_wherever_a_stretch_is_cut():
    lengths = (np.array([1, 2, 3, 5]), np.array([1, 2, 4]))
    a, b = np.array([1, 2, 0, 3, 1, 0]), np.array([2, 0, 1, 1, 2, 0])
    ends = [np.cumsum(n[ids]) for n, ids in zip(lengths, (a, b))]
    assert ends[0][-1] == ends[1][-1]
    whole = alignment.Sweep(lengths)
    whole.feed(0, 0, a)
    whole.feed(1, 0, b)
    whole.close()
    want = whole.told()
    for cut in range(1, int(ends[0][-1])):
        machine = alignment.Sweep(lengths)
        for low, high in ((0, cut), (cut, 1 << 20)):
            for side, ids in ((0, a), (1, b)):
                some = np.flatnonzero((ends[side] > low) & (ends[side] <= high))
                if len(some):
                    machine.feed(side, int(ends[side][some[0] - 1]) if some[0] else 0, ids[some])
            machine.close()
        got = machine.told()
        assert got[:5] == want[:5]
        assert (got[5] == want[5]).all() and (got[6] == want[6]).all()


def test_packed_pairs_come_back():
    press, open_ = zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()
    rng = np.random.default_rng(0)
    for n in (0, 1, 5000):
        pairs = np.unique(rng.integers(0, 50_000 * 32_000, n))
        times = rng.integers(1, 70_000 if n else 2, len(pairs))
        back = alignment.unpack(alignment.pack(pairs, times, 32_000, press), 32_000, open_)
        assert (back[0] == pairs).all() and (back[1] == times).all()


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], DOCS)).count() == 0
    only_null = spark.createDataFrame([(7, None, "", "")], DOCS)
    assert [tuple(r) for r in alignment.align(only_null).collect()] == [(7, 0, 0, 0, 0, 0, 0, "")]
