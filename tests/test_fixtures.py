"""Small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from helixmill.functions import names
from helixmill.functions.paths import node_bounds, path_nodes
from helixmill.operators import classify, coverage, ranges, seqstats, species, strain


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_classification(spark):
    reads = spark.createDataFrame([("r1", ">1<6"), ("r2", ">7"), ("r3", ">6>7"), ("r4", "x")], "rid string, path string")
    held = spark.createDataFrame([("A", 1, 6, 0), ("B", 7, 9, 1)], "species string, start bigint, end bigint, ord int")
    want = [("r1", "A"), ("r2", "B"), ("r3", "U"), ("r4", "U")]
    assert rows(classify.classify_by_range(reads, held), "rid", "species") == want
    assert rows(classify.classify_by_bucket(reads, held, width=4), "rid", "species") == want
    assert sorted(map(str, rows(classify.overlap_any(reads, held)))) == sorted(map(str, [("r1", "A"), ("r2", "B"), ("r3", "A"), ("r4", None)]))


@pytest.mark.parametrize("most", [classify.BROADCAST_ROWS, 10])
def test_no_read_is_compared_with_all_ranges(spark, monkeypatch, most):
    monkeypatch.setattr(classify, "BROADCAST_ROWS", most)
    held = spark.range(300).selectExpr("concat('S', id) as species", "id * 100 + 1 as start", "id * 100 + if(id % 50 = 0, 100, 90) as end")
    reads = spark.range(0, 30_200, 7).selectExpr("cast(id as string) as rid", "concat('>', id, '<', id + id % 5) as path")
    found = classify.classify_by_range(reads, held)
    spans = {b: (b * 100 + 1, b * 100 + (100 if b % 50 == 0 else 90)) for b in range(300)}
    want = {str(i): next((f"S{b}" for b in {i // 100, (i - 1) // 100} & spans.keys() if spans[b][0] <= i and i + i % 5 <= spans[b][1]), "U") for i in range(0, 30_200, 7)}
    assert dict(rows(found, "rid", "species")) == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("quality", "kept"), [([60] + [3] * 2 + [0] * 17, True), ([60, 3] + [0] * 18, False), ([3] * 20, False)])
def test_species_filter(spark, quality, kept):
    reads = spark.createDataFrame([("A", q, 10) for q in quality] + [("U", 60, 10)], "species string, mapq int, read_len bigint")
    assert rows(species.species_bases(reads)) == ([("A", 200)] if kept else [])
    assert rows(species.species_bases(reads, equal_len=7, filtered=False)) == [("A", 140)]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([("A", i + 1, n) for i, n in enumerate([5, 3, 4, 6, 2, 5])], "species string, node_id bigint, node_len bigint")
    paths = {"h1": [1, 2, 3, 4], "h2": [1, 2, 5, 4], "h3": [1, 2, 3, 6]}
    walks = spark.createDataFrame([("A", h, i, n) for h, p in paths.items() for i, n in enumerate(p)], "species string, hap_id string, pos int, node_id bigint")
    reads = [("r1", ">1>2>3>4", 2, 14), ("r2", "<4<5<2", 1, 8), ("r3", ">3", 1, 3), ("r4", ">3", 3, 1), ("r5", ">2>5>2", 0, 6), ("r6", ">3", None, 2)]
    reads = spark.createDataFrame([(a, "A", b, c, d) for a, b, c, d in reads], "rid string, species string, path string, read_start bigint, read_end bigint")
    return nodes, walks, coverage.read_nodes(reads, nodes).cache()


def test_depth_and_breadth(graph):
    nodes, _, visits = graph
    assert rows(coverage.node_depth(visits, nodes), "node_id", "bases") == [(1, 3), (2, 6), (3, 6), (4, 7), (5, 4), (6, 0)]
    assert [round(r[1], 4) for r in rows(coverage.node_depth(visits, nodes), "node_id", "depth")] == [0.6, 2.0, 1.5, 1.1667, 2.0, 0.0]
    assert rows(coverage.node_breadth(visits, nodes), "node_id", "covered") == [(1, 3), (2, 3), (3, 4), (4, 6), (5, 2), (6, 0)]


def test_triples_and_filters(graph):
    nodes, walks, visits = graph
    haps = coverage.triple_haps(coverage.unique_triples(coverage.walk_triples(walks)), nodes)
    assert rows(haps, "a", "b", "c", "hap_id", "trio_len") == [(1, 2, 5, "h2", 10), (2, 3, 4, "h1", 13), (2, 3, 6, "h3", 12), (2, 5, 4, "h2", 11)]
    depth = coverage.triple_depth(visits, haps)
    assert rows(depth.filter("bases > 0"), "a", "b", "c", "bases") == [(2, 3, 4, 9), (2, 5, 4, 7)]
    first = strain.first_filter(depth)
    assert rows(first, "hap_id", "fraction", "mean", "keep") == [("h1", 1.0, 0.0, True), ("h2", 0.5, 0.0, True), ("h3", 0.0, 0.0, False)]
    ratio = {r[0]: r[1] for r in rows(coverage.path_breadth(walks, nodes, coverage.node_breadth(visits, nodes)), "hap_id", "path_base_cov")}
    assert ratio["h1"] == pytest.approx(16 / 18)
    assert ratio["h2"] == pytest.approx(14 / 16)


def test_trimmed_mean(spark):
    values = [("a", 1.0)] * 11 + [("a", 100.0)] + [("b", 2.0)] * 3 + [("c", 7.0)]
    got = rows(strain.trimmed_mean(spark.createDataFrame(values, "k string, v double"), ["k"], "v"))
    assert got == [("a", 1.0), ("b", 0.0), ("c", 0.0)]


def test_shift_threshold(spark):
    got = spark.createDataFrame([(20.0,), (0.5,), (150.0,)], "m double").select(strain.shift_threshold(F.col("m"), 0.3)).collect()
    assert [round(r[0], 6) for r in got] == [0.4, 0.15, 0.8]


@pytest.mark.parametrize(("mean", "fraction", "cover", "keep", "rescue"), [(4.0, 1.0, 1.0, True, False), (3.0, 0.95, 0.9, True, True), (3.0, 0.9, 0.9, False, False), (2.0, 1.0, 1.0, False, False), (0.0, 1.0, 1.0, False, False)])
def test_second_filter(spark, mean, fraction, cover, keep, rescue):
    df = spark.createDataFrame([("A", "h", fraction, mean, cover, 10.0)], "species string, hap_id string, fraction double, mean double, path_base_cov double, first_sol double")
    got = strain.second_filter(df).first()
    assert (got.keep, got.is_rescue) == (keep, rescue)


def test_constraints(spark):
    df = spark.createDataFrame([("A", "h1", 20.0, 12.0, False), ("A", "h2", 2.0, 3.0, True)], "species string, hap_id string, first_sol double, second_sol double, is_rescue boolean")
    got = {r.hap_id: r for r in strain.constrain(df, spark.createDataFrame([("A", 10.0)], "species string, coverage double")).collect()}
    assert got["h2"].second_sol == 2.0
    assert got["h1"].second_sol == pytest.approx(12 * 10 / 14)
    assert got["h1"].total_cov_diff == pytest.approx(4 / 12)


def test_ranges(spark):
    local = spark.createDataFrame([("A", 1, 10, 1, 0), ("B", 1, 5, 1, 1), ("C", 1, 7, 0, 2)], "species string, start bigint, end bigint, is_pan int, ord bigint")
    assert rows(ranges.rebase(local), "start", "end") == [(1, 10), (11, 15), (16, 22)]
    second = spark.createDataFrame([("C", 1, 7, 1), ("D", 8, 9, 0)], "species string, start bigint, end bigint, is_pan int")
    merged = ranges.merge_databases([ranges.rebase(local).filter("species <> 'C'"), second])
    assert rows(merged, "species", "start", "end") == [("A", 1, 10), ("B", 11, 15), ("C", 16, 22), ("D", 23, 24)]


def test_names(spark):
    path = "../genomes/GCF_006400955.1_ASM640095v1_genomic.fna.gz"
    got = spark.createDataFrame([(path,), ("MGYG000002538_genomic.fna",)], "p string").select(names.file_stem(F.col("p")), names.hap_id(F.col("p")), names.is_fasta(F.col("p"))).collect()
    assert tuple(got[0]) == ("GCF_006400955.1_ASM640095v1_genomic.fna", "GCF_006400955.1", True)
    assert got[1][1] == "MGYG000002538_genomic"
    ids = names.number_repeats(spark.createDataFrame([(5, 1), (5, 2), (7, 3)], "t int, o int"), "t", "o", "s")
    assert [r[1] for r in rows(ids, "o", "s")] == ["5.1", "5.2", "7"]


def test_nxx(spark):
    lengths = spark.createDataFrame([("g", x) for x in (5, 4, 3, 3)], "genome string, len bigint")
    assert rows(seqstats.nxx(lengths, ["genome"], 0.5, "x")) == [("g", 4)]
    assert rows(seqstats.nxx(lengths, ["genome"], 0.9, "x")) == [("g", 3)]


def test_best_alignment_is_judged_after_it_is_chosen(spark):
    df = spark.createDataFrame([("a", "r", 900, 0.99, 60, 1500), ("b", "r", 900, 0.98, 60, 1500), ("c", "r", 950, 0.9, 10, 2000), ("d", "s", 9, 0.9, 30, 1001), ("e", "s", 9, 0.9, 30, 1001)], "rid string, read_id string, matches int, identity double, mapq int, span int")
    assert rows(classify.best_alignments(df), "read_id", "rid") == [("s", "d")]


def test_duplicate_reads(spark):
    df = spark.createDataFrame([("1", "x", "A"), ("2", "x", "A"), ("3", "y", "A"), ("4", "y", "B")], "rid string, read_id string, species string")
    assert rows(classify.unique_read_ids(df), "rid", "unique_id") == [("1", "x"), ("2", "x_2")]


def test_paths(spark):
    got = spark.createDataFrame([(">1<22>3",), ("",), (None,)], "p string").select(path_nodes(F.col("p")), *node_bounds(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [([1, 22, 3], 1, 22), ([], -1, -1), (None, -1, -1)]


def test_degenerate_species(spark):
    walks = [("one", "h", 0, 1), ("same", "h1", 0, 1), ("same", "h2", 0, 1), ("mixed", "h1", 0, 1), ("mixed", "h2", 0, 2)]
    walks = spark.createDataFrame(walks, "species string, hap_id string, pos int, node_id bigint")
    depth = spark.createDataFrame([(s, n, float(n)) for s in ("one", "same", "mixed") for n in (1, 2)], "species string, node_id bigint, depth double")
    unique = coverage.unique_triples(coverage.walk_triples(walks))
    got = {(r.species, r.hap_id): r["mean"] for r in strain.degenerate_filter(walks, depth, unique).collect()}
    assert got == {("one", "h"): 1.5, ("same", "h1"): 1.5, ("mixed", "h1"): None, ("mixed", "h2"): None}
