"""The pipeline's near copies against all pairs in plain Python."""

import random

import numpy as np

import corpus_pipeline
from helixmill.llm import nearcopies
from tests.llm.test_search import classes


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"x{rng.randrange(10**9)}"
    return out


def corpus():
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line = fresh(60)
    texts = [None, "", " \n", "One two", "one  TWO", "one three"]
    for _ in range(30):
        base = fresh(rng.randrange(60, 300))
        texts += [" ".join(edited(rng, base, rng.randrange(0, len(base) // 25))) for _ in range(5)]
    texts += [" ".join(fresh(20) + line + fresh(rng.randrange(0, 20))) for _ in range(60)]
    dense = fresh(200)
    texts += [" ".join(edited(rng, dense, rng.randrange(0, 8))) for _ in range(80)]
    chain = fresh(150)
    for _ in range(12):
        chain = edited(rng, chain, 2)
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    return texts


def test_near_copies_are_all_pairs_of_similarity_08(spark, monkeypatch):
    texts = corpus()
    sets = [grams(t) for t in texts]
    links = []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 9 * len(a & b) >= 4 * (len(a) + len(b)):
                links.append((i, j))
    want = classes(len(texts), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string").repartition(3)
    for tree in (1024, 8):  # whole trees, and shards searched in parts
        monkeypatch.setattr(nearcopies, "TREE", tree)
        got = {r.row: r.first for r in nearcopies.near_copies(docs).select("row", "first").collect()}
        assert classes(len(texts), got.items()) == want
        assert all(got[i] == min(j for j in got if want[j] == want[i]) for i in got)
    assert not nearcopies.near_copies(docs.limit(0)).collect()


def test_stage_drops_a_copy_with_changed_words(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    other = edited(rng, base, 7)
    assert len(grams(" ".join(base)) & grams(" ".join(other))) / len(grams(" ".join(base)) | grams(" ".join(other))) >= 0.8
    rows = [(1, " ".join(base), "en", "s", 0), (2, " ".join(other), "en", "s", 0), (3, " ".join(base[:200]), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)
    assert sorted(r.doc_id for r in corpus_pipeline.simhash(spark, docs, "").collect()) == [1, 3]


def test_bounds_never_drop_a_similar_pair():
    rng = np.random.default_rng(5)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, rng.integers(2, 3000)).astype(np.uint64)
        share = rng.random()
        a, b = (np.unique(pool[rng.random(len(pool)) < 0.7 + 0.3 * share]) for _ in range(2))
        if not len(a) or not len(b):
            continue
        x, y = (np.frombuffer(nearcopies.parities(v), np.uint64) for v in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
        similar = 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b))
        kept = nearcopies.may_be_similar(np.array([len(a)]), x[None], np.array([len(b)]), y[None])[0]
        assert kept or not similar


def test_texts_of_similarity_08_share_a_shard_and_lie_within_the_radius():
    rng = np.random.default_rng(6)
    met, near = [], []
    for _ in range(400):
        n = int(rng.integers(40, 400))
        both = rng.integers(0, 1 << 63, n).astype(np.uint64)
        own = [rng.integers(0, 1 << 63, n // 8).astype(np.uint64) for _ in range(2)]  # a similarity of 0.8
        a, b = (np.unique(np.concatenate([both, x])) for x in own)
        met.append((nearcopies.band_keys(a) == nearcopies.band_keys(b)).any())
        near.append((nearcopies.simhash_of(a) ^ nearcopies.simhash_of(b)).bit_count() <= nearcopies.RADIUS)
    assert np.mean(met) > 0.99
    assert np.mean(near) > 0.99


def test_search_gives_the_near_pairs_of_other_groups():
    import pyarrow as pa

    rng = np.random.default_rng(7)
    rows = []
    for key, n in enumerate((1, 5, 1, 30, 2)):
        base = rng.integers(0, 1 << 62)
        for r in range(n):
            fp = int(base) ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 25), replace=False))
            rows.append((key, 0, key * 100 + r, int(rng.integers(0, 3)), bool(rng.random() < 0.6), True, fp, 10, bytes(nearcopies.BUCKETS // 8), [-1 - key * 100 - r, key]))
    want = set()
    for x in rows:
        for y in rows:
            if x[0] == y[0] and x[4] and x[3] != y[3] and (x[6] ^ y[6]).bit_count() <= nearcopies.RADIUS:
                want.add((min(x[2], y[2]), max(x[2], y[2])))
    names = ["key", "part", "row", "root", "asks", "member", "fp", "size", "parities", "keys"]
    for step in (1, 3, 7, 100):
        cut = [rows[i : i + step] for i in range(0, len(rows), step)]
        made = nearcopies._search(pa.record_batch([pa.array(c) for c in zip(*part)], names) for part in cut)
        assert sorted((p["a"], p["b"]) for b in made for p in b.to_pylist()) == sorted(want)


def test_long_texts_are_cut_between_shingles(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(" " * rng.randrange(3) + f"w{rng.randrange(50)}" * rng.randrange(1, 9) for _ in range(n)) for n in (0, 3, 7, 200, 900)]
    want = [x.tolist() for x in nearcopies.shingle_sets(texts)]
    monkeypatch.setattr(nearcopies, "CHUNK", 64)
    assert [x.tolist() for x in nearcopies.shingle_sets(texts)] == want


def test_all_pairs_come_from_searches_of_trees(spark, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    rows = []
    for key, groups in enumerate(([1], [1, 1], [40], [3, 1, 30, 1, 1, 20])):
        for g, n in enumerate(groups):
            base = int(rng.integers(0, 1 << 62))
            rows += [(key, 0, key * 1000 + g * 100 + r, base ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 9), replace=False))) for r in range(n)]
    near = lambda x, y: x[0] == y[0] and (x[3] ^ y[3]).bit_count() <= nearcopies.RADIUS
    allowed = {(x[2], y[2]) for x in rows for y in rows if x[2] < y[2] and near(x, y)}
    for step in (1, 7, 200):
        made = nearcopies._lead(pa.record_batch([pa.array(c) for c in zip(*rows[i : i + step])], ["key", "part", "row", "fp"]) for i in range(0, len(rows), step))
        got = [(p["a"], p["b"]) for b in made for p in b.to_pylist()]
        assert set(got) <= allowed and classes(4000, got) == classes(4000, list(allowed))
        assert len(got) < 4 * len(rows)  # a dense group isn't listed pair by pair
    # Without its trees the stage finds nothing.
    docs = spark.createDataFrame(list(enumerate(corpus())), "row bigint, text string")
    same = {tuple(sorted(grams(t))) for t in corpus()}
    monkeypatch.setattr(nearcopies, "lean", lambda func: lambda batches: iter(()) if func in (nearcopies._lead, nearcopies._search) else func(batches))
    assert nearcopies.near_copies(docs).select("first").distinct().count() == len(same)
