"""The source audit against its SQL and against plain integers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from helixmill.llm import divergence

DOCS = "doc_id bigint, text string, lang string, source string, term string, chunk string"


def plain(rows):
    """(lang, source, part, item, value, rank) from counters and Python's integers."""
    rows = [((text or ""), (lang or ""), (source or "")) for text, lang, source in rows]
    out = []
    for lang in sorted({r[1] for r in rows}):
        docs, counts = Counter(), defaultdict(Counter)
        for text, of, source in rows:
            if of == lang:
                words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]
                docs.update(set(words))
                counts[source].update(words)
        kept = sorted((t for t, n in docs.items() if n >= 3), key=str.encode)
        every = Counter()
        for c in counts.values():
            every.update(c)

        def share(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return [1 + 1_000_000_000 * (c[t] + 1) // total for t in kept]

        p, q = {s: share(c) for s, c in counts.items()}, share(every)
        f = lambda a, b: (a - b) * (a - b) // b
        for s, c in counts.items():
            pairs = [(-sum(f(a, b) for a, b in zip(p[s], p[t])), t.encode(), t) for t in p if t != s]
            best = [(-f(a, b), t.encode(), t) for t, a, b in zip(kept, p[s], q) if c[t] and a > b]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:200])):
                out += [(lang, s, part, t, -v, i + 1) for i, (v, _, t) in enumerate(found)]
    return sorted(out)


def rows_of(rng, n):
    words = ["abc", "ABC", "é", "É", "zz", "日本", "\U0001f600", "a1b", "x_y", "￿", "~", "q"] + [f"w{'abcdefghij'[i % 10] * (i // 10 + 1)}" for i in range(60)]
    out = []
    for _ in range(n):
        lang = [None, "", "de", "en", "fr\0x"][rng.integers(0, 5)]
        source = [None, "", "s1", "s2", "s3", "é", "\U0001f600", "￿"][int(8 * rng.random() ** 2)]
        text = None if rng.random() < 0.1 else " ".join(words[int(len(words) * rng.random() ** 2)] for _ in range(rng.integers(0, 40)))
        out.append((text, lang, source))
    return [*out, ("lone", "zz", "only"), (None, "yy", "a"), (None, "yy", "b")]


@pytest.mark.parametrize(("chunk", "block"), [(divergence.CHUNK, divergence.BLOCK), (7, 3), (1, 1)])
def test_against_integers(spark, chunk, block):
    rows = rows_of(np.random.default_rng(5), 250)
    docs = spark.createDataFrame([(i, *r, "x", "y") for i, r in enumerate(rows)], DOCS)
    got = divergence.audit(docs, chunk=chunk, block=block)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == plain(rows)


def test_only_the_first_terms_are_told(spark):
    words = ["".join("abcdefghij"[int(c)] for c in str(i)) for i in range(260)]
    rows = [(" ".join(words), "de", "s1")] * 3 + [("other words", "de", "s2")] * 3
    docs = spark.createDataFrame([(i, *r, "", "") for i, r in enumerate(rows)], DOCS)
    got = sorted(map(tuple, divergence.audit(docs, chunk=16).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == plain(rows)
    assert max(r[5] for r in got if r[2] == "term") == 200


def test_shares_are_exact():
    rng = np.random.default_rng(2)
    for total in (1, 7, 10**9 + 7, 9 * 10**15):
        count = np.unique(np.r_[1, total, rng.integers(1, total + 1, 200)])
        assert divergence.scaled(count, total).tolist() == [1 + 10**9 * int(c) // total for c in count]
    with pytest.raises(OverflowError):
        divergence.scaled(np.array([1]), 1 << 62)


def test_dense_vectors_hold_counts_that_floats_do_not():
    large = (1 << 60) + 1
    assert divergence.dense(np.array([2, 0]), np.array([large, 3]), 4).tolist() == [3, 0, large, 0]


def test_long_terms_and_empty_tables(spark):
    long = "日" * 200_000
    rows = [(long, "de", "s1")] * 3 + [(long + "本", "de", "s2")] * 3
    docs = spark.createDataFrame([(i, *r, "", "") for i, r in enumerate(rows)], DOCS)
    got = sorted(map(tuple, divergence.audit(docs, chunk=1).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == plain(rows)
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
