"""Pairs of vectors by blocks, and what clusters take from them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.operators import cluster, pairs


@pytest.mark.parametrize("least", [None, 20.0])
def test_cosines_are_those_of_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(pairs, "BLOCK", 7)
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, [float(x) for x in rng.normal(size=5)]) for i in range(60)]
    rows += [(60, 0, None), (61, 1, [1.0, None, 0.0, 0.0, 0.0]), (62, 0, [1.0, 2.0]), (63, 0, [2.0, 1.0]), (64, 1, [0.0] * 5), (65, None, [1.0] * 5)]
    vectors = spark.createDataFrame(rows, "id bigint, label int, e array<float>")
    found = pairs.cosines(vectors, least)
    got = {(r.label, r.query, r.refer): r.ani for r in found.collect()}
    want = {}
    for i, a, x in rows:
        for j, b, y in rows:
            if i < j and a is not None and a == b:
                known = x and y and len(x) == len(y) and None not in x + y and any(x) and any(y)
                p, q = (np.asarray(v, np.float32).astype(float) if known else None for v in (x, y))
                want[a, i, j] = 100 * float(p @ q) / float(np.sqrt((p @ p) * (q @ q))) if known else None
    if least is not None:
        want = {k: v for k, v in want.items() if v is not None and round(v, 6) >= least}
    assert got.keys() == want.keys() and found.count() == len(got)
    assert all(got[k] == pytest.approx(v, abs=1e-6) if v is not None else got[k] is None for k, v in want.items())


@pytest.mark.parametrize("seed", range(20))
def test_complete_linkage_from_near_pairs_alone(seed):
    rng = np.random.default_rng(seed)
    points = rng.random((int(rng.integers(1, 40)), 2))
    dist = np.linalg.norm(points[:, None] - points[None], axis=2)
    a, b = np.nonzero(np.triu(dist <= 0.3, 1))
    assert cluster.complete_clusters(len(points), a, b, dist[a, b]).tolist() == cluster.linkage_clusters(dist, 0.3).tolist()


def test_complete_linkage_holds_no_matrix():
    n = 60_000  # a matrix would take 29 GB
    a = np.arange(n - 1)
    got = cluster.complete_clusters(n, a, a + 1, np.where(a % 2 == 0, 1.0, 2.0))
    assert (got == np.arange(n) // 2).all()


def test_medoids_and_nearest_representatives_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 7)
    rng = np.random.default_rng(3)
    points = [[float(x) for x in rng.normal(size=4)] for _ in range(70)]
    points[20:26] = [points[20]] * 6  # equal vectors tie
    points += [[-x for x in points[0]], None, [0.0] * 4, [1.0, None, 0.0, 0.0]]
    rows = [(i, i // 2 % 2, e) for i, e in enumerate(points)]
    vectors = spark.createDataFrame(rows, "id bigint, label int, e array<float>")
    genomes = vectors.select("label", "id").withColumnRenamed("id", "genome")
    edges = pairs.cosines(vectors)
    members = cluster.components(genomes, edges, 95.0).withColumnRenamed("component", "cluster")
    odd = genomes.selectExpr("label", "genome", "0L as cluster")  # with vectors that have no cosine
    for clusters in (odd, members):
        got, want = pairs.medoids(vectors, clusters), cluster.medoids(clusters, edges)
        assert sorted(got.collect()) == sorted(want.select(got.columns).collect())
    assert sorted(pairs.reassign(vectors, want).collect()) == sorted(cluster.reassign(genomes, want, edges).collect())


def test_medoids_compare_few_members_with_all(spark):
    rng = np.random.default_rng(4)
    n = 1500
    points = rng.normal(size=(n, 3)) + 3
    vectors = spark.createDataFrame([(i, 1, [float(x) for x in p]) for i, p in enumerate(points)], "id bigint, label int, e array<double>")
    members = vectors.selectExpr("label", "id as genome", "0L as cluster")
    asked = []

    def between(some, others, **options):
        asked.append(some.count() * others.count())
        return found(some, others, **options)

    found = pairs.cosines_between
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pairs, "cosines_between", between)
        got = pairs.medoids(vectors, members).first().genome
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    assert got == int(np.argmax((unit @ unit.T).sum(axis=1)))
    assert sum(asked) <= 20 * n


def test_spanning_pairs_connect_what_all_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 200)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 6))
    rows = [(i, i % 2, [float(x) for x in centres[i % 9] + 0.05 * rng.normal(size=6)]) for i in range(300)]
    rows += [(300, 0, None), (301, 1, [0.0] * 6), (302, 0, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id bigint, label int, e array<double>")
    genomes = vectors.select("label", F.col("id").alias("genome"))
    every, few = pairs.cosines(vectors, 90.0), pairs.cosines(vectors, 90.0, spanning=True)
    told = {tuple(r) for r in few.collect()}
    assert told <= {tuple(r) for r in every.collect()}
    assert len(told) < len(rows) < every.count() / 3  # all pairs grow with the square
    assert sorted(cluster.components(genomes, few, 90.0).collect()) == sorted(cluster.components(genomes, every, 90.0).collect())


def test_only_pairs_near_a_bound_are_summed_in_order(monkeypatch):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(200, 16)), rng.normal(size=(300, 16))
    b[7] = 0
    asked = []
    told = pairs._told
    monkeypatch.setattr(pairs, "_told", lambda a, b, i, j: asked.append(len(i)) or told(a, b, i, j))
    monkeypatch.setattr(pairs, "STRIPE", 64)
    ids = [np.arange(200), np.arange(1000, 1300)]
    sides, norms = [(np.arange(len(v)), v) for v in (a, b)], [pairs._own(v) for v in (a, b)]
    plain = list(pairs._every(ids, [[s] for s in sides], [[n] for n in norms], False, 60.0, False))
    found = list(pairs._chosen(ids, *sides, *norms, False, 60.0, False, False))
    for want, got in zip(plain, found, strict=True):
        assert all((x == y).all() for x, y in zip(want, got))  # the values to the last bit
    assert sum(asked) < 0.05 * 200 * 300
    nearest = list(pairs._chosen(ids, *sides, *norms, False, None, True, False))
    for want, got in zip(pairs._every(ids, [[s] for s in sides], [[n] for n in norms], False, None, True), nearest, strict=True):
        assert all((x == y).all() for x, y in zip(want, got))


@pytest.mark.parametrize("edges", [5, 1_000_000])
def test_components_take_few_rounds(spark, monkeypatch, edges):
    monkeypatch.setattr(cluster, "TREE_EDGES", edges)
    chain = [(int(a), int(b)) for a, b in zip(*(lambda p: (p[:-1], p[1:]))(np.random.default_rng(7).permutation(60)))]
    frame = spark.createDataFrame([(1, a, b, 99.0) for a, b in [*chain, (70, 71), (71, 70), (72, 72)]], "label int, query bigint, refer bigint, ani double")
    genomes = spark.range(74).selectExpr("1 as label", "id as genome")
    rounds = []
    joined = cluster._joined
    monkeypatch.setattr(cluster, "_joined", lambda x: rounds.append(1) or joined(x))
    got = {r.genome: r.component for r in cluster.components(genomes, frame, 95.0).collect()}
    assert got == {i: 0 if i < 60 else 70 if i == 71 else i for i in range(74)}
    assert len(rounds) <= (2 if edges > 100 else 8)


def test_blocks_of_a_large_label_travel_as_singles_to_few_others(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 4)
    monkeypatch.setattr(pairs, "ROWS", 5)
    rng = np.random.default_rng(9)
    points = rng.normal(size=(200, 3)).astype(np.float32)
    vectors = spark.createDataFrame([(i, 1, [float(x) for x in p]) for i, p in enumerate(points)], "id bigint, label int, e array<float>")
    packed = pairs._packed(pairs._known(vectors))
    assert packed.schema["es"].dataType.simpleString() == "array<array<float>>"
    assert packed.first()._blocks == 13  # 50 would hold 4 each
    told = pairs.cosines(vectors)
    e = points.astype(float)
    unit = e / np.linalg.norm(e, axis=1)[:, None]
    got = {(r.query, r.refer): r.ani for r in told.collect()}
    assert got == pytest.approx({(i, j): 100 * float(unit[i] @ unit[j]) for i in range(200) for j in range(i + 1, 200)}, abs=1e-6)
    wide = spark.createDataFrame([(i, 1, [1.0] * 300) for i in range(60)], "id bigint, label int, e array<double>")
    assert pairs._packed(pairs._known(wide)).first()._blocks == 15


def test_filtered_matrix_compares_kept_genomes_and_keeps_no_rows(spark, monkeypatch):
    from helixmill.operators import cut
    from helixmill.plans import bindings, catalog

    folder = "/root/testdata/sf0.001"
    asked = []
    cosines = bindings.cosines
    monkeypatch.setattr(bindings, "cosines", lambda v, *a, **o: asked.append(v.count()) or cosines(v, *a, **o))
    cut.remove_cuts(spark)
    frame = catalog.QUERIES["sc19_filter_matrix"](spark, folder)
    kept = bindings.genomes(spark, folder).filter("n50 >= 500").count()
    assert asked == [kept]
    assert [spark.read.parquet(p).columns[-1] for p in cut._written] == ["es"]  # the vectors, not the pairs
    n = bindings.vectors(spark, folder).join(bindings.genomes(spark, folder).filter("n50 >= 500").selectExpr("label", "genome as id"), ["label", "id"]).groupBy("label").count()
    assert frame.count() == n.selectExpr("sum(count * (count - 1) div 2)").first()[0]


def test_complete_linkage_of_a_large_component_goes_round_by_round(spark, monkeypatch):
    rng = np.random.default_rng(10)
    points = rng.random((150, 2))
    dist = np.linalg.norm(points[:, None] - points[None], axis=2) * 100
    rows = [(1 + i % 2, i, j, float(100 - dist[i, j])) for i in range(150) for j in range(i + 1, 150) if i % 2 == j % 2]
    edges = spark.createDataFrame(rows, "label int, query bigint, refer bigint, ani double")
    genomes = spark.createDataFrame([(1 + i % 2, i) for i in range(150)] + [(1, 200), (2, 201)], "label int, genome bigint")
    want = {200: 200, 201: 201}
    for k in (0, 1):
        own = np.arange(k, 150, 2)
        number = cluster.linkage_clusters(dist[np.ix_(own, own)], 40.0)
        want |= {int(g): int(own[number == c].min()) for g, c in zip(own, number)}
    assert 4 < len(set(want.values())) < 30
    seen = []
    monkeypatch.setattr(cluster, "_merged", lambda e, merged=cluster._merged: seen.append(e.count()) or merged(e))
    for most in (10**6, 300, 0):
        monkeypatch.setattr(cluster, "LINKAGE_PAIRS", most)
        got = {r.genome: r.cluster for r in cluster.hierarchical(genomes, edges, 60.0).collect()}
        assert got == want
        assert bool(seen) == (most < 10**6)
    assert len(seen) < 30  # rounds of both
