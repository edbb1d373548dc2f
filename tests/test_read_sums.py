"""Sums along reads without a row per visit, against the sums of visits."""

import numpy as np
import pytest

from helixmill.operators import coverage


def rows_of(rng, n):
    out = []
    for i in range(n):
        species = ["A", "A", "A", "B", "C", "U", None][rng.integers(0, 7)]
        steps = rng.integers(1, 9, rng.integers(0, 6))
        path = None if rng.random() < 0.05 else "".join(("<" if rng.random() < 0.3 else ">") + str(int(x)) for x in steps)
        start, end = int(rng.integers(0, 8)), int(rng.integers(-2, 40))
        out.append((f"r{i}", species, path, start, None if rng.random() < 0.05 else end))
    return out


@pytest.mark.parametrize("most_reads", [coverage.MOST_READS, 20])
def test_against_visits(spark, most_reads):
    rng = np.random.default_rng(most_reads % 97)
    reads = spark.createDataFrame(rows_of(rng, 400), "rid string, species string, path string, read_start bigint, read_end bigint").repartition(3)
    lens = [(s, int(i), int(rng.integers(1, 9))) for s, some in (("A", range(1, 9)), ("B", (1, 3, 4, 7)), ("D", (1, 2))) for i in some]
    nodes = spark.createDataFrame(lens, "species string, node_id bigint, node_len bigint")
    want_nodes, want_threes = coverage.visit_sums(coverage.read_nodes(reads, nodes))
    nodes_got, threes_got = coverage.read_sums(reads, nodes, most_reads)
    zero = lambda r: tuple(0 if n == "bases" and v is None else v for n, v in r.asDict().items())
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(zero, nodes_got.collect()), key=key) == sorted(map(zero, want_nodes.collect()), key=key)
    assert sorted(map(tuple, threes_got.collect())) == sorted(map(tuple, want_threes.collect()))


def test_rows_of_one_read_are_one_read(spark):
    rows = [("r1", "A", ">1>2>3", 1, 9), ("r1", "A", ">1>2>3", 1, 30), ("r2", "A", ">2>2", 0, 5), ("r1", "B", ">1", 0, 2), ("r3", "A", ">3", 0, 3)]
    reads = spark.createDataFrame(rows, "rid string, species string, path string, read_start bigint, read_end bigint").repartition(2)
    nodes = spark.createDataFrame([(s, i, 20) for s in "AB" for i in (1, 2, 3)], "species string, node_id bigint, node_len bigint")
    want_nodes, want_threes = coverage.visit_sums(coverage.read_nodes(reads, nodes))
    for most in (coverage.MOST_READS, 1):
        got_nodes, got_threes = coverage.read_sums(reads, nodes, most)
        zero = lambda x: sorted((r.species, r.node_id, -1 if r.low is None else r.low, r.bases or 0, r.high or 0) for r in x.collect())
        assert zero(got_nodes) == zero(want_nodes)
        assert sorted(map(tuple, got_threes.collect())) == sorted(map(tuple, want_threes.collect()))


def test_reads_that_go_on_in_the_next_batch(spark):
    rng = np.random.default_rng(6)
    reads = spark.createDataFrame([(f"r{i % 90}", "A", "".join(f">{int(x)}" for x in rng.integers(1, 9, 3)), 0, 50) for i in range(90)], "rid string, species string, path string, read_start bigint, read_end bigint")
    nodes = spark.createDataFrame([("A", i, 7) for i in range(1, 9)], "species string, node_id bigint, node_len bigint")
    want = sorted(map(tuple, coverage.read_sums(reads, nodes)[1].collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert sorted(map(tuple, coverage.read_sums(reads, nodes)[1].collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_reads_and_no_nodes(spark):
    reads = spark.createDataFrame([("r", "A", ">1>2>3", 0, 5)], "rid string, species string, path string, read_start bigint, read_end bigint")
    nodes = spark.createDataFrame([("A", 1, 5)], "species string, node_id bigint, node_len bigint")
    for r, n in ((reads.limit(0), nodes), (reads, nodes.limit(0))):
        assert [x.count() for x in coverage.read_sums(r, n)] == [0, 0]


def test_reads_are_not_taken_apart_one_by_one():
    """Rows of a batch are told apart in columns: no object of Python per row."""
    import pyarrow as pa

    from helixmill.operators import coverage

    n = 20_000
    at = [None] * n
    column = {"species": pa.array(["S"] * (n + 1)), "salt": pa.array([0] * (n + 1), pa.int32()), "block": pa.array([0, *at], pa.int64())}
    column |= {"ids": pa.array([[1, 2]] * (n + 1)), "lens": pa.array([[5, 5], *at], pa.list_(pa.int64()))}
    column |= {x: pa.array([None, *[v] * n], pa.int64()) for x, v in (("start", 1), ("end", 8))}
    batch = pa.record_batch(column | {"rid": pa.array([None, *(str(i) for i in range(n))])})

    class Columns:
        num_rows = batch.num_rows

        def slice(self, *args):
            return batch.slice(*args)

        def column(self, i):
            asked.append(i)
            return Listless(batch.column(i))

    class Listless:
        def __init__(self, held):
            self.held = held

        def __getattr__(self, name):
            assert name != "to_pylist"
            return getattr(self.held, name)

        def __getitem__(self, i):
            return self.held[i]

        def __len__(self):
            return len(self.held)

    asked: list[int] = []
    rows = [r for part in coverage._summed(iter([Columns()])) for r in part.to_pylist()]
    assert asked and sum(r["bases"] for r in rows if not r["three"]) == 7 * n
