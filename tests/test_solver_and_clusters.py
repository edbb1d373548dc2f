"""The path solver against an exhaustive search, and clustering against plain methods."""

from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.operators import cliques, cluster, lad, refine, scan


def best_objective(a, d, w):
    """Some optimum fits as many nodes exactly, or paths at zero, as there are paths."""
    n, p = a.shape
    rows = [(a[i], d[i]) for i in range(n)] + [(np.eye(p)[j], 0.0) for j in range(p)]
    best = np.inf
    for pick in combinations(range(len(rows)), p):
        m = np.array([rows[i][0] for i in pick])
        if abs(np.linalg.det(m)) < 1e-9:
            continue
        x = np.linalg.solve(m, np.array([rows[i][1] for i in pick]))
        if (x >= -1e-9).all():
            best = min(best, lad.objective(a, d, w, np.maximum(x, 0)))
    return best


@pytest.mark.parametrize("seed", range(40))
def test_solver_reaches_the_optimum(seed):
    rng = np.random.default_rng(seed)
    n, p = int(rng.integers(1, 9)), int(rng.integers(1, 4))
    a = (rng.random((n, p)) < 0.6).astype(float)
    d, w = rng.integers(1, 9, n).astype(float), rng.integers(1, 4, n).astype(float)
    x = lad.fit_paths(a, d, w)
    assert (x >= 0).all()
    assert lad.objective(a, d, w, x) == pytest.approx(best_objective(a, d, w), abs=1e-7)


def test_known_fits():
    assert lad.fit_paths(np.ones((3, 1)), np.array([2.0, 4, 9]), np.ones(3)) == pytest.approx([4])
    x = lad.fit_paths(np.array([[1.0, 0], [1, 1], [0, 1]]), np.array([3.0, 5, 2]), np.ones(3))
    assert x == pytest.approx([3, 2])


def test_fit_species(spark):
    walks = spark.createDataFrame([("A", h, n) for h, n in (("h1", 1), ("h1", 2), ("h2", 2), ("h2", 3))], "species string, hap_id string, node_id bigint")
    depth = spark.createDataFrame([("A", 1, 3.0), ("A", 2, 5.0), ("A", 3, 2.0), ("A", 4, 9.0)], "species string, node_id bigint, depth double")
    got = {r.hap_id: r.x for r in lad.fit_species(walks, depth).collect()}
    assert got == pytest.approx({"h1": 3, "h2": 2})


def planted_cells(rng, species, paths, cells):
    """Cells of species with planted abundances and noise, depths mostly distinct."""
    rows = []
    for s in range(species):
        x = rng.integers(1, 30, paths)
        for _ in range(cells):
            on = np.flatnonzero(rng.random(paths) < 0.5)
            if len(on):
                depth = float(max(0.1, x[on].sum() + rng.choice([0.0, rng.normal(0, 3), rng.normal(0, 20)])))
                rows.append((f"s{s}", [f"h{h}" for h in on], depth, int(rng.integers(1, 4))))
    return rows


@pytest.mark.parametrize("paths", [1, 2, 5])
def test_refinement_reaches_the_optimum_of_a_single_task(spark, paths, monkeypatch):
    rng = np.random.default_rng(paths)
    rows = planted_cells(rng, 3, paths, 1500)
    cells = spark.createDataFrame(rows, "species string, haps array<string>, depth double, n bigint")
    sizes = []
    plain = refine.intervals
    monkeypatch.setattr(refine, "intervals", lambda c, k: (sizes.append(plain(c, k).groupBy("species").count().agg({"count": "max"}).first()[0]), plain(c, k))[1])
    fits = refine.fit_large(cells).collect()
    for s in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == s]
        names, matrix = lad.incidence_of([r[1] for r in own])
        d, w = np.array([r[2] for r in own]), np.array([r[3] for r in own], float)
        want = lad.objective(matrix, d, w, lad.fit_paths(matrix, d, w))
        x = {r.hap_id: r.x for r in fits if r.species == s}
        assert lad.objective(matrix, d, w, np.array([x[n] for n in names])) == pytest.approx(want, rel=1e-9)
        told = next(r for r in fits if r.species == s)
        assert told.objective * w.sum() == pytest.approx(want, rel=1e-9)
        assert abs(told.gap) < 1e-7
    assert max(sizes) < 0.5 * len(rows) / 3  # of 1,500 cells a task holds the intervals only


def test_species_of_any_size_are_fitted_alike(spark):
    rng = np.random.default_rng(8)
    walks, depth = [], []
    for s, n in (("big", 400), ("mid", 60), ("a", 20), ("b", 20), ("c", 3)):
        for node in range(n):
            on = [h for h in ("h1", "h2", "h3") if rng.random() < 0.6]
            walks += [(s, h, node) for h in on]
            depth.append((s, node, float(rng.normal(20, 5) * max(1, len(on)))))
    walks = spark.createDataFrame(walks, "species string, hap_id string, node_id bigint")
    depth = spark.createDataFrame(depth, "species string, node_id bigint, depth double")
    plain = {(r.species, r.hap_id): r.objective for r in lad.fit_species(walks, depth).collect()}
    for most in (0, 30, 100):
        got = {(r.species, r.hap_id): r.objective for r in lad.fit_species(walks, depth, most_cells=most).collect()}
        assert got == pytest.approx(plain, rel=1e-9)


def test_no_task_has_over_twice_the_mean(spark):
    rng = np.random.default_rng(9)
    for tasks in (1, 4, 7):
        sizes = [(f"s{i}", int(n)) for i, n in enumerate((1000 / (1 + np.arange(300)) ** 0.8).astype(int))]
        rng.shuffle(sizes)
        mean = sum(int(n) for _, n in sizes) / tasks
        frame = spark.createDataFrame([(k, int(n)) for k, n in sizes], "species string, cells bigint")
        dealt = {r.species: r.task for r in scan.dealt_by_size(frame, "species", "cells", tasks).collect()}
        assert len(dealt) == 300
        loads = [sum(int(n) for k, n in sizes if dealt[k] == t) for t in range(tasks)]
        assert max(loads) <= 2 * max(mean, 1000 / 2)
        assert set(dealt.values()) <= set(range(tasks))


@pytest.mark.parametrize("parts", [1, 5])
def test_running_totals(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(int(k), int(v) if v else None) for k, v in zip(rng.permutation(200), rng.integers(0, 9, 200))]
    frame = spark.createDataFrame(rows, "k bigint, v bigint").repartition(parts)
    want, before = {}, 0
    for k, v in sorted(rows, reverse=True):
        want[k] = before
        before += v or 0
    totals = scan.running_total(frame, [F.desc("k")], "v", "before")
    assert {r.k: r.before for r in totals.collect()} == want
    assert "SinglePartition" not in totals._jdf.queryExecution().executedPlan().toString()
    assert [r.n for r in scan.numbered(frame, [F.asc("k")], "n").orderBy("k").collect()] == list(range(1, 201))
    assert scan.running_total(frame.limit(0), [F.asc("k")], "v", "before").count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_cliques(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 10))
    edges = [(i, j) for i, j in combinations(range(n), 2) if rng.random() < rng.choice([0.3, 0.6, 0.9])]
    linked = set(edges)
    every = [list(c) for size in range(n, 0, -1) for c in combinations(range(n), size) if all(e in linked for e in combinations(c, 2))]
    wanted = {int(v) for v in rng.integers(0, n, rng.integers(0, 3))}
    want = every[:1] + [c for c in every if wanted & set(c)][:1]
    assert cliques.best_cliques(edges, list(range(n)), wanted) == want


def test_a_dense_group_of_genomes_ends_in_seconds():
    import time

    rng = np.random.default_rng(4)
    linked = rng.random((300, 300)) < 0.7
    inside = rng.choice(300, 60, replace=False)
    linked[np.ix_(inside, inside)] = True
    edges = [(i, j) for i, j in combinations(range(300), 2) if linked[i, j]]
    began = time.perf_counter()
    found = cliques.best_cliques(edges, list(range(300)), {int(inside[0])})
    assert time.perf_counter() - began < 60
    assert all(set(map(int, inside)) <= set(c) for c in found) and len(found) == 2


@pytest.mark.parametrize(("method", "seed"), list(product(("single", "complete", "average"), range(5))))
def test_linkage(method, seed):
    rng = np.random.default_rng(seed)
    x = rng.random((8, 2))
    dist = np.linalg.norm(x[:, None] - x[None], axis=2)
    how = {"single": np.min, "complete": np.max, "average": np.mean}[method]
    groups = [[i] for i in range(8)]
    while len(groups) > 1:
        gap, i, j = min((how(dist[np.ix_(groups[i], groups[j])]), i, j) for i, j in combinations(range(len(groups)), 2))
        if gap > 0.4:
            break
        groups[i] += groups.pop(j)
    got = cluster.linkage_clusters(dist, 0.4, method)
    assert sorted(sorted(np.flatnonzero(got == k).tolist()) for k in set(got)) == sorted(sorted(g) for g in groups)


def test_components_of_a_chain(spark):
    n = 200
    genomes = spark.createDataFrame([(0, i) for i in range(n + 1)], "label int, genome bigint")
    edges = spark.createDataFrame([(0, i, i + 1, 99.95) for i in range(n - 1)], "label int, query bigint, refer bigint, ani double")
    got = {r.genome: r.component for r in cluster.components(genomes, edges, 99.9).collect()}
    assert got == {i: (0 if i < n else n) for i in range(n + 1)}


@pytest.mark.parametrize("seed", range(30))
def test_a_dual_solution_proves_each_fit(seed):
    rng = np.random.default_rng(100 + seed)
    n, p = int(rng.integers(2, 40)), int(rng.integers(1, 7))
    a = (rng.random((n, p)) < 0.5).astype(float)
    d, w = rng.random(n) * 9, rng.integers(1, 4, n).astype(float)
    x, gap = lad.fit_with_gap(a, d, w)
    assert gap == pytest.approx(0, abs=1e-7)
    worse = x + rng.random(p)
    assert lad.objective(a, d, w, x) <= lad.objective(a, d, w, worse) + 1e-9


def test_a_solver_without_an_end_says_so():
    with pytest.raises(RuntimeError, match="no optimum within 1 steps"):
        lad._simplex(np.array([[1.0, 1], [1, 0], [0, 1]]), np.array([3.0, 1, 5]), np.ones(3), steps=1)


def test_linkage_inside_components_is_linkage_of_all(spark):
    rng = np.random.default_rng(3)
    points = rng.random((24, 2)) * 12
    pairs = [(0, i, j, float(100 - np.linalg.norm(points[i] - points[j]))) for i, j in combinations(range(24), 2)]
    genomes = spark.createDataFrame([(0, i) for i in range(24)], "label int, genome bigint")
    edges = spark.createDataFrame(pairs, "label int, query bigint, refer bigint, ani double")
    dist = np.linalg.norm(points[:, None] - points[None], axis=2)
    for method in ("single", "complete", "average"):
        want = cluster.linkage_clusters(dist, 3.0, method)
        got = {r.genome: r.cluster for r in cluster.hierarchical(genomes, edges, 97.0, method).collect()}
        assert [[i for i in range(24) if got[i] == c] for c in sorted(set(got.values()))] == [np.flatnonzero(want == k).tolist() for k in sorted(set(want), key=lambda k: np.flatnonzero(want == k)[0])]
        assert all(c == min(i for i in got if got[i] == c) for c in got.values())


def test_sample_is_per_species_and_only_above_the_limit(spark):
    from helixmill.operators import strain

    rows = [(s, n, float(n % 3)) for s, many in (("a", 3000), ("b", 30)) for n in range(many)]
    got = strain.sample_nodes(spark.createDataFrame(rows, "species string, node_id bigint, depth double"), most=500).collect()
    assert sum(r.species == "a" for r in got) == 500
    assert sum(r.species == "b" for r in got) == 20
    assert all(r.depth > 0 for r in got)
