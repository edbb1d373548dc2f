"""Graph search against brute force."""

import numpy as np
import pytest

from helixmill.llm import neighbours

ROWS = "vec_id bigint, embedding array<float>, label int, cid string, shard string"


def exact(rows, top=10):
    """(query_id, vec_id, score) of the nearest, summed from the first component on in double precision."""
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, x in good:
        if q % 100 == 0:
            near = out.setdefault(q, {})  # an id with several vectors is as near as the nearest of them
            for i, y in good:
                if i != q and len(x) == len(y):
                    score = float(np.sqrt(np.cumsum((np.array(y, float) - np.array(x, float)) ** 2)[-1]))
                    near[i] = min(score, near.get(i, np.inf))
    return {q: sorted((s, i) for i, s in near.items())[:top] for q, near in out.items()}


def search(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], ROWS)
    got = neighbours.nearest(frame, frame.filter("vec_id % 100 = 0"), **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    out = {}
    for r in sorted(got.collect()):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def single(x):
    return [[float(np.float32(v)) for v in r] for r in x]


@pytest.mark.parametrize("shard", [neighbours.SHARD, 150])
def test_clusters(spark, shard):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 16))
    rows = list(enumerate(single(centres[rng.integers(0, 30, 1500)] + 0.2 * rng.normal(size=(1500, 16)))))
    got, want = search(spark, rows, shard=shard), exact(rows)
    assert got.keys() == want.keys()
    found = np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want])
    assert found >= 0.97
    for q in want:
        assert set(got[q]) <= {(s, i) for s, i in got[q]}
        assert got[q] == sorted(got[q])
        true = {i: s for s, i in want[q]}
        assert all(s == true[i] for s, i in got[q] if i in true)


def test_every_case(spark):
    rng = np.random.default_rng(1)
    same = single(rng.normal(size=(1, 8)))[0]
    rows = [(i, same) for i in range(0, 400, 7)] + [(i, v) for i, v in enumerate(single(rng.normal(size=(150, 8))), 1000)]
    rows += [(2000, None), (2100, []), (2200, [0.0] * 8), (2300, [float("nan")] + [1.0] * 7), (2400, [None] + [1.0] * 7), (2500, [float("inf")] * 8), (None, same)]
    rows += [(2600, [1.0, 2.0]), (2601, [1.0, 2.5]), (2700, [3.0])]
    rows += [rows[0], rows[60], (1000, single(rng.normal(size=(1, 8)))[0])]
    got, want = search(spark, rows), exact(rows)
    assert got == {q: w for q, w in want.items() if w}
    assert 2700 not in got and [i for _, i in got[2600]] == [2601]


def test_a_third_of_the_rows_alike(spark):
    rng = np.random.default_rng(2)
    same = single(rng.normal(size=(1, 8)))[0]
    rows = [(i, same if i % 3 == 0 else v) for i, v in enumerate(single(rng.normal(size=(2000, 8))))]
    got, want = search(spark, rows, shard=300), exact(rows)
    assert [got[q] for q in want if q % 3 == 0] == [want[q] for q in want if q % 3 == 0]


def test_empty_table(spark):
    assert search(spark, []) == {}
    assert search(spark, [(100, [1.0, 0.0])]) == {}


def test_all_points_are_reached_and_edges_are_few():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(400, 6)), 50 + 0.01 * rng.normal(size=(300, 6)), -50 + 1e-6 * rng.normal(size=(200, 6))])
    graph, entries = neighbours.build_graph(x, degree=8, beam=24)
    seen = np.zeros(len(x), bool)
    for e in entries:
        neighbours._reached(graph, int(e), seen)
    assert seen.all()
    assert graph.shape == (901, 8) and (graph[-1] == -1).all()
    assert not (graph[:-1] == np.arange(len(x))[:, None]).any()


def test_pruning_keeps_directions():
    x = np.array([[0.0, 0], [1, 0], [1.1, 0], [0, 1.5], [3, 0], [-2, 0]])
    ids = np.array([[1, 2, 3, 4, 5, -1]])
    dist = neighbours.squared(x, ids, x[:1])
    assert neighbours.robust_prune(x, ids, dist, 4, 1.2).tolist() == [[1, 3, 5, -1]]
