"""Near-duplicate searches against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from helixmill.llm import components, passages, pivots, simhash

DOCS = "doc_id bigint, text string, fp string, row string, content string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], DOCS)


def classes(n, linked):
    """Smallest member of each item's component, for pairs (i, j)."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


EDGE = [None, "", " \n", "A", "a b", "A B c", "é ß x\u0085y z", "a b c a b c a b c", "w " * 5000]


def test_fingerprints():
    rng = random.Random(0)
    for text in EDGE + [" ".join(rng.choice("abcdeABC") for _ in range(rng.randrange(200))) for _ in range(50)]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("shard_rows", [1024, 12])
def test_links(spark, shard_rows):
    rng = np.random.default_rng(1)
    values = list(rng.integers(0, 1 << 63, 150, dtype=np.uint64))
    for v in values[:60]:
        for _ in range(3):
            x = int(v)
            for _ in range(rng.integers(0, 4)):
                x ^= 1 << int(rng.integers(0, 64))
            values.append(np.uint64(x))
    for _ in range(150):  # a dense ball
        x = int(values[0])
        for _ in range(rng.integers(0, 4)):
            x ^= 1 << int(rng.integers(0, 10))
        values.append(np.uint64(x))
    v = np.unique(np.array(values, np.uint64))
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 2
    want = classes(len(v), zip(*np.nonzero(near)))
    links = simhash.link_fingerprints(spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp bigint"), shard_rows=shard_rows)
    at = {int(x): i for i, x in enumerate(v.view(np.int64))}
    pairs = [(at[r.a], at[r.b]) for r in links.collect()]
    assert classes(len(v), pairs) == want


@pytest.mark.parametrize(("parts", "radius"), [(3, 2), (4, 2), (5, 2)])
def test_masks_meet(parts, radius):
    masks = simhash.block_masks(parts, radius)
    rng = np.random.default_rng(2)
    for _ in range(200):
        x = int(rng.integers(0, 1 << 63))
        y = x
        for _ in range(radius):
            y ^= 1 << int(rng.integers(0, 64))
        assert any(x & m == y & m for m in masks)


def test_documents(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts = list(EDGE) + [None, ""]
    for _ in range(12):
        t = [rng.choice(words) for _ in range(400)]
        texts.append(" ".join(t))
        for _ in range(3):
            t = list(t)
            t[rng.randrange(400)] = rng.choice(words)
            texts.append(" ".join(t).upper())
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts))
    fp = [plain_fingerprint(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fp[i] ^ fp[j]).count("1") <= 2]
    cls = classes(len(rows), linked)
    least = {c: min(ids[i] for i in range(len(rows)) if cls[i] == c) for c in set(cls)}
    got = simhash.near_duplicates(docs_of(spark, rows + rows[:2] + [(None, "alone in this")]))
    got = got.select("doc_id", simhash.hex_digits(got.fp).alias("f"), "component_id").collect()
    assert len(got) == len(rows) + 3
    for r in got:
        if r.doc_id is not None:
            i = ids.index(r.doc_id)
            assert (r.f, r.component_id) == (f"{fp[i]:016x}", least[cls[i]])
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_long_chain(spark):
    n = 700
    df = spark.createDataFrame([(i, i + 1) for i in range(n)], "a bigint, b bigint")
    assert {r.root for r in components.connected_components(df).collect()} and len({r.root for r in components.connected_components(df).collect()}) == 1
    star = spark.createDataFrame([(i, 500) for i in range(400)] + [(1000, 1001)], "a bigint, b bigint")
    got = {r.node: r.root for r in components.connected_components(star).collect()}
    assert len({got[i] for i in [*range(400), 500]}) == 1
    assert got[1000] == got[1001] != got[0]


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1, None):
        for _ in range(60):
            x = rng.standard_normal(16)
            rows.append((label, x))
            for _ in range(int(rng.integers(0, 4))):
                rows.append((label, x + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.1]) * np.linalg.norm(x) / 4))
    hot = rng.standard_normal(16)
    rows += [(1, hot + rng.standard_normal(16) * 0.02) for _ in range(150)]
    odd = [(0, None), (0, [0.0] * 16), (0, [float("nan")] * 16), (0, [1.0, None] * 8), (0, []), (0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [float("inf")] * 16)]
    table = [(i, e if e is None else [None if v is None else float(np.float32(v)) for v in e], label, "x", "x") for i, (label, e) in enumerate(rows + odd)]
    good = [i for i, (_, e, label, *_x) in enumerate(table) if label is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    linked = []
    for a in good:
        for b in good:
            if a < b and table[a][2] == table[b][2] and len(table[a][1]) == len(table[b][1]):
                x, y = np.array(table[a][1]), np.array(table[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    linked.append((a, b))
    degree = defaultdict(int)
    for a, b in linked:
        degree[a] += 1
        degree[b] += 1
    cls = classes(len(table), linked)
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<float>, label int, cid string, copies string")
    got = {r.vec_id: r for r in pivots.near_duplicates(df).collect()}
    assert len(got) == len(table)
    assert all(got[i].n_links <= degree[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(degree.values())
    assert sum(got[i].component_id == cls[i] for i in got) >= 0.97 * len(got)
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert pivots.near_duplicates(df.filter("vec_id < 0")).count() == 0


def naive_windows(h):
    out = []
    for c in range(len(h)):
        a = b = c
        while h[c] and a > 0 and h[a - 1] > h[c]:
            a -= 1
        while h[c] and b < len(h) - 1 and h[b + 1] >= h[c]:
            b += 1
        if h[c] and b - a + 1 >= passages.SHORTEST:
            out.append((c, min(c - a, passages.REACH), min(b - c, passages.REACH)))
    return out


@pytest.mark.parametrize("n", [0, 10, 46, 300, 1500])
def test_windows(n):
    rng = np.random.default_rng(n)
    h = rng.integers(1, 1 << 62 if n % 100 else 40, n).astype(np.uint64)
    h[rng.integers(0, max(n, 1), n // 150)] = 0
    at, left, right = passages.compact_windows(h)
    assert list(zip(at.tolist(), left.tolist(), right.tolist())) == naive_windows(h)


def test_shingles_are_equal_where_words_are():
    texts = [b"One two three\nfour five six", b"", b"zero one TWO three four  five", b"a b", b"x"]
    sh, first = passages.shingles(texts)
    assert first.tolist() == [0, 6, 6, 12, 14, 15]
    assert sh[0] == sh[7] > 0
    assert [i for i, x in enumerate(sh) if x] == [0, 1, 6, 7]


def test_passages(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    shared, short = text(51), text(30)
    near = list(shared)
    near[25] = word()
    rows = [(i, text(40 + 7 * i) + shared + text(30)) for i in range(6)]
    rows += [(10 + i, text(50) + short + text(50)) for i in range(4)]
    rows += [(20, text(90) + near), (30, text(200)), (31, text(3))]
    whole = text(300)
    rows += [(40, whole), (41, whole), (42, whole[:150] + text(1) + whole[150:])]
    rows = [(i, " ".join(t)) for i, t in rows] + [(50, None), (51, ""), (52, "tiny text"), (53, "tiny text")]
    got = {r.doc_id: r for r in passages.near_duplicate_passages(docs_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i in range(6):
        assert got[i].class_id == 0
        spans = [tuple(map(int, s.split(":"))) for s in got[i].spans.split(",")]
        assert len(spans) == 1
        assert abs(spans[0][0] - (40 + 7 * i)) <= 2
        assert abs(spans[0][1] - (91 + 7 * i)) <= 2
    assert got[20].class_id == 0
    assert all(got[i].n_links == 0 and got[i].class_id == i for i in (10, 11, 12, 13, 30, 31, 50))
    assert {got[i].class_id for i in (40, 41, 42)} == {40}
    assert got[40].copies == 2
    assert got[53].class_id == 52
    assert got[40].dup_words >= 280
    assert passages.near_duplicate_passages(docs_of(spark, [])).count() == 0


def plain_links(texts):
    """Pairs of texts, and texts with themselves, that share 46 shingles of which 0.8 agree, a word of shift allowed: all offsets tried."""
    grams = [[tuple(t[i : i + 5]) for i in range(len(t) - 4)] for t in texts]
    ids = {}
    sh = [np.array([ids.setdefault(g, len(ids)) for g in x], np.int64) for x in grams]
    links = set()
    for i, a in enumerate(sh):
        for j in range(i + 1):
            b = sh[j]
            if not len(np.intersect1d(a, b)):
                continue
            for d in range(-len(b) + 1, len(a)):
                if i == j and abs(d) < passages.SHORTEST:
                    continue
                at = np.arange(max(0, d), min(len(a), len(b) + d))
                same = np.zeros(len(at), bool)
                for shift in (-1, 0, 1):
                    k = at - d + shift
                    ok = (k >= 0) & (k < len(b))
                    same[ok] |= a[at[ok]] == b[k[ok]]
                sums = np.r_[0, np.cumsum(same)]
                if len(at) >= passages.SHORTEST and (sums[passages.SHORTEST :] - sums[: -passages.SHORTEST]).max() >= 0.8 * passages.SHORTEST:
                    links.add((j, i))
                    break
    return links


def test_links_and_repeats_against_all_offsets(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    texts = []
    for size, many in ((60, 5), (80, 3), (55, 2), (300, 4)):
        passage = text(size)
        for _ in range(many):
            own = list(passage)
            if size != 60:
                own[rng.randrange(8, size - 8)] = word()  # near-copies of each other
            texts.append(text(rng.randrange(60)) + own + text(rng.randrange(60)))
    nine, left = text(9), [text(50) for _ in range(6)]
    texts += [text(30) + nine + text(30) for _ in range(25)]  # nine words in unlike surroundings
    texts += [text(20) + x[:25] + nine + x[25:] + text(20) for x in left for _ in range(2)]  # and in like ones
    again = text(60)
    texts += [text(10) + again + text(50) + again + text(5) + again, text(400), text(40) * 5]
    links = plain_links(texts)
    want = [sum(i in x and x[0] != x[1] for x in links) for i in range(len(texts))]
    got = {r.doc_id: r for r in passages.near_duplicate_passages(docs_of(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    found = [got[i].n_links for i in range(len(texts))]
    # Edits next to each other in a passage of just 50 words may leave no window in common; all else is found.
    assert sum(min(a, b) for a, b in zip(found, want)) >= 0.95 * sum(want)
    assert [a >= b for a, b in zip(found, want)].count(False) <= 2
    groups = [4] * 5 + [2] * 3 + [1] * 2 + [3] * 4 + [0] * 25 + [1] * 12 + [0] * 3
    assert all(a <= b for a, b in zip(found, groups))  # and only texts of one group are linked
    assert found[:5] == want[:5] == [4] * 5
    repeats = [i for i in range(len(texts)) if (i, i) in links]
    assert [i for i in got if got[i].n_repeats] == repeats
    assert got[len(texts) - 3].n_repeats == 2
    assert len(got[len(texts) - 3].spans.split(",")) in (2, 3)


def random_words(rng, n):
    return ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]


def test_a_common_run_shorter_than_a_passage_links_nothing(spark):
    rng = random.Random(21)
    run = random_words(rng, 40)
    rows = [(i, " ".join(random_words(rng, 60) + run + random_words(rng, 60))) for i in range(300)]
    got = passages.near_duplicate_passages(docs_of(spark, rows)).collect()
    assert all(r.n_links == 0 and r.class_id == r.doc_id and r.spans == "" for r in got)


def test_runs_of_any_length_and_edited_passages_by_the_rule(spark):
    rng = random.Random(22)
    texts = []
    for size in range(36, 61):
        run = random_words(rng, size)
        texts += [random_words(rng, 50) + run + random_words(rng, 50) for _ in range(2)]
    for edits in (1, 2, 3):
        for _ in range(4):
            passage = random_words(rng, 70)
            near = list(passage)
            for at in rng.sample(range(70), edits):
                near[at] = random_words(rng, 1)[0]
            texts += [random_words(rng, 30) + x + random_words(rng, 30) for x in (passage, near)]
    want = {x for x in plain_links(texts) if x[0] != x[1]}
    got = {r.doc_id: r.class_id for r in passages.near_duplicate_passages(docs_of(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    found = {(got[i], i) for i in got if got[i] != i}
    assert found <= want  # nothing but what the rule links
    assert not want - found or all(b >= 50 for _, b in want - found)  # whole runs are all found,
    assert len(want - found) <= 2  # and edits leave a common window but for a few


def test_agreeing_passages_are_runs_of_places():
    rng = np.random.default_rng(23)
    for _ in range(200):
        a = rng.integers(1, 1 << 60, (1, 150), dtype=np.uint64)
        b = np.where(rng.random((1, 150)) < rng.choice([0.1, 0.2, 0.3]), rng.integers(1, 1 << 60, (1, 150), dtype=np.uint64), a)
        b[0, rng.integers(0, 150) :] = 1
        same = [x == y or x in (b[0, max(0, i - 1)], b[0, min(149, i + 1)]) for i, (x, y) in enumerate(zip(a[0], b[0]))]
        good = [sum(same[i : i + passages.SHORTEST]) >= 0.8 * passages.SHORTEST for i in range(150 - passages.SHORTEST + 1)]
        want, i = [], 0
        while i < len(good):
            if good[i]:
                j = i
                while j + 1 < len(good) and good[j + 1]:
                    j += 1
                inside = [k for k in range(i, j + passages.SHORTEST) if same[k]]
                want.append((0, inside[0], inside[-1]))
                i = j
            i += 1
        assert list(zip(*(x.tolist() for x in passages.agreeing_passages(a, b)))) == want


def test_texts_whose_hashes_clash_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(24)
    one, two = (" ".join(random_words(rng, 60)) for _ in range(2))
    plain = passages.F.xxhash64
    monkeypatch.setattr(passages.F, "xxhash64", lambda *c: F.lit(7).cast("bigint") if [x for x in c if isinstance(x, str)] == ["text"] and len(c) == 1 else plain(*c))
    got = {r.doc_id: (r.class_id, r.copies) for r in passages.near_duplicate_passages(docs_of(spark, [(1, one), (2, two), (3, one)])).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2)}


def test_runs_of_a_key_are_thinned_and_nothing_else():
    rng = np.random.default_rng(13)
    for _ in range(100):
        n = int(rng.integers(0, 60))
        owner, key = np.sort(rng.integers(0, 3, n)), rng.integers(0, 3, n).astype(np.uint64)
        at = np.sort(rng.choice(900, n, replace=False))
        kept = set(passages.spaced(owner, key, at).tolist())
        for i in range(n):
            own = [j for j in range(n) if (owner[j], key[j]) == (owner[i], key[i])]
            near = [j for j in own if j in kept and abs(at[j] - at[i]) < passages.SHORTEST]
            assert near
            place = own.index(i)
            lone = all(abs(at[own[j]] - at[i]) >= passages.SHORTEST for j in (place - 1, place + 1) if 0 <= j < len(own))
            edge = any(not 0 <= j < len(own) or abs(at[own[j]] - at[i]) >= passages.SHORTEST for j in (place - 1, place + 1))
            assert i in kept or not (lone or edge)


def test_finer_keys_meet_in_like_surroundings():
    rng = np.random.default_rng(12)
    met = 0
    for _ in range(300):
        a = rng.integers(1, 1 << 62, 200).astype(np.uint64)
        b = rng.integers(1, 1 << 62, 200).astype(np.uint64)
        start = int(rng.integers(75, 100))
        b[start - 20 : start + 26] = a[start - 20 : start + 26]
        met += (passages.finer_keys(a, np.array([start])) == passages.finer_keys(b, np.array([start]))).any()
    assert met == 300


def brute_links(x, threshold=0.93):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= threshold
    np.fill_diagonal(close, False)
    return close


@pytest.mark.parametrize("noise", [(0.01, 0.02), (0.02, 0.1), (0.05, 0.3)])
def test_a_dense_group_of_vectors(spark, noise):
    """Cells whose members link as a whole, cells that their radii leave open, and vectors of their own."""
    rng = np.random.default_rng(21)
    base = rng.standard_normal((3, 24))
    x = np.concatenate([b + s * rng.standard_normal((120, 24)) for b in base for s in noise] + [rng.standard_normal((80, 24))])
    x = np.concatenate([x, x[:40]])  # copies
    close = brute_links(x)
    table = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in pivots.near_duplicates(spark.createDataFrame(table, "vec_id bigint, embedding array<double>, label int")).collect()}
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= close.sum(axis=1)).all()
    assert found.sum() >= 0.97 * close.sum()
    cls = classes(len(x), list(zip(*np.nonzero(close))))
    assert np.mean([got[i].component_id == cls[i] for i in range(len(x))]) >= 0.97


def test_lists_need_pivots_that_rank_high_for_both():
    a = sum(p << 8 * i for i, p in enumerate((5, 9, 2, 7, 11, 40)))
    b = sum(p << 8 * i for i, p in enumerate((9, 5, 2, 60, 61, 62)))
    c = sum(p << 8 * i for i, p in enumerate((50, 51, 52, 11, 40, 7)))
    keys = pivots.list_keys(np.ones(3, np.uint64), np.array([a, b, c], np.uint64), 6)
    assert keys.shape == (3, len(pivots.threes(6)))
    assert len(np.intersect1d(keys[0], keys[1])) == 1  # 2, 5 and 9, in whatever order
    assert len(np.intersect1d(keys[0], keys[2])) == 0  # 7, 11 and 40 rank low
    other = pivots.list_keys(np.full(1, 2, np.uint64), np.array([a], np.uint64), 6)
    assert len(np.intersect1d(keys[0], other[0])) == 0
