"""The stored sketch index: what it finds, what it reads, and that it isn't shuffled."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from helixmill.operators import index
from helixmill.plans import lifecycles

COMPLEMENT = str.maketrans("ACGT", "TGCA")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(0)
    rows = [(g, rng.randrange(1 << 63)) for g in "abc" for _ in range(4000)]
    rows += [("d", gram) for g, gram in rows if g == "a" and gram % 3]
    path = str(tmp_path_factory.mktemp("index") / "it's stored")
    index.write_index(spark.createDataFrame(rows, "genome string, gram bigint"), path, 31, 1, buckets=4)
    return path, rows


def asked(spark, rows, share):
    rng = random.Random(1)
    return spark.createDataFrame([(gram,) for g, gram in rows if rng.random() < share.get(g, 0)] + [(1,), (1,)], "gram bigint")


@pytest.mark.parametrize("broadcast", [0, index.BROADCAST_GRAMS])
@pytest.mark.parametrize("scale", [1, 7])
def test_containment_at_any_coarser_scale(spark, stored, scale, broadcast):
    path, rows = stored
    sample = asked(spark, rows, {"a": 1, "b": 0.5})
    held = {r.gram for r in sample.collect()}
    want = {}
    for g, gram in set(rows):
        if gram < (1 << 63) // scale:
            n, hit = want.get(g, (0, 0))
            want[g] = (n + 1, hit + (gram in held))
    got = index.genomes_in_sample(index.open_index(spark, path), sample, scale, broadcast).collect()
    assert {r.genome: (r.grams, r.shared) for r in got} == want
    for r in got:
        assert r.ani == pytest.approx(100 * (r.shared / r.grams) ** (1 / 31))


@pytest.mark.parametrize("broadcast", [0, index.BROADCAST_GRAMS])
def test_the_index_is_not_shuffled_and_its_bound_reaches_the_files(spark, stored, broadcast):
    path, rows = stored
    found = index.genomes_in_sample(index.open_index(spark, path), asked(spark, rows, {"a": 1}), 7, broadcast)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "genome#" in line)
    assert f"LessThan(gram,{(1 << 63) // 7})" in scan
    # Between the join and the scan of the postings there is no exchange.
    lines = plan[: plan.index(scan)].splitlines()
    depth = len(re.match(r"[\s:+|-]*", scan)[0])
    above, least = [], depth
    for line in reversed(lines):
        at = len(re.match(r"[\s:+|-]*", line)[0])
        if at < least:
            least = at
            above.append(line)
    upto = next(i for i, line in enumerate(above) if "Join" in line)
    assert not any("Exchange" in line for line in above[:upto])
    assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan or broadcast


def test_a_finer_scale_is_refused(spark, tmp_path):
    index.write_index(spark.createDataFrame([("a", 5)], "genome string, gram bigint"), str(tmp_path / "i"), 21, 8, buckets=2)
    held = index.open_index(spark, str(tmp_path / "i"))
    assert (held.k, held.scale) == (21, 8)
    with pytest.raises(ValueError):
        index.genomes_in_sample(held, spark.createDataFrame([(5,)], "gram bigint"), 4)
    assert index.genomes_in_sample(held, spark.createDataFrame([], "gram bigint")).first().shared == 0
    index.close_index(spark, str(tmp_path / "i"))


def test_rewriting_an_index(spark, tmp_path):
    for genome in ("old", "new"):
        index.write_index(spark.createDataFrame([(genome, 5)], "genome string, gram bigint"), str(tmp_path / "i"), 21, 1, buckets=2)
        assert [r.genome for r in index.open_index(spark, str(tmp_path / "i")).postings.collect()] == [genome]


def test_fast_mode_from_files_to_files(spark, tmp_path):
    rng = random.Random(2)
    genomes = {f"GCF_{i}.1_x.fna": "".join(rng.choices("ACGT", k=6000)) for i in range(4)}
    genomes["GCF_9.1_x.fna"] = "".join(c if rng.random() > 0.05 else rng.choice("ACGT") for c in genomes["GCF_0.1_x.fna"])
    (tmp_path / "g").mkdir()
    for name, seq in genomes.items():
        (tmp_path / "g" / name).write_text(f">c1\n{seq[:3000]}\n{seq[3000:5000]}\n>c2 tail\n{seq[5000:]}\n")
    reads = []
    for name in ("GCF_0.1_x.fna", "GCF_2.1_x.fna"):
        for start in [*range(0, 2900, 50), *range(3000, 4900, 50), *range(5000, 5900, 50)]:
            end = next(e for e in (5000, 6000) if start < e)
            read = genomes[name][start : min(start + 150, end)]
            reads.append(read if start % 100 else read.translate(COMPLEMENT)[::-1])
    (tmp_path / "r.fq").write_text("".join(f"@r{i}\n{r.lower() if i % 2 else r}\n+\n{'I' * len(r)}\n" for i, r in enumerate(reads)))
    lifecycles.index_genomes(spark, str(tmp_path / "g" / "*.fna"), str(tmp_path / "index"), scale=4, buckets=4)
    info = spark.createDataFrame([(n[:7], f"1.{i}", "1", "x", f"/far/{n}") for i, n in enumerate(genomes)], "genome_ID string, strain_taxid string, species_taxid string, organism_name string, id string")
    for scale in (None, 16):
        kept = lifecycles.fast_filter(spark, str(tmp_path / "index"), str(tmp_path / "r.fq"), info, str(tmp_path / f"out{scale}"), scale=scale)
        assert sorted(r.genome_ID for r in kept.collect()) == ["GCF_0.1", "GCF_2.1"]
        assert spark.read.csv(str(tmp_path / f"out{scale}" / "genomes_info.txt"), sep="\t", header=True).count() == 2


def test_queries_leave_one_table_at_most(spark):
    from helixmill.operators import cut
    from helixmill.plans import catalog

    for name in ("fast_filter", "sc3_gaf", "gr12_components", "ag1_equal_len_filtered"):
        cut.remove_cuts(spark)
        frame = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(cut._written) <= 1
        assert frame.agg(F.count(F.lit(1))).first()[0] > 0


def test_banded_pairs_find_all_similar_genomes(spark, monkeypatch):
    from itertools import combinations
    from math import log

    from helixmill.operators import sketch

    monkeypatch.setattr(sketch, "BAND_BLOCK", 16)  # a band of 60 is dealt out by blocks
    rng = random.Random(7)
    sets = {}
    for family in range(12):
        base = [rng.randrange(1 << 62) for _ in range(150)]
        for member in range(60 if family == 0 else 4):
            kept = [x if rng.random() > 0.06 else rng.randrange(1 << 62) for x in base]
            sets[100 * family + member] = frozenset(kept if member != 3 else base)
    for copy in range(40):
        sets[2000 + copy] = sets[103]
    rows = [(1, g, x) for g, grams in sets.items() for x in grams] + [(2, 5000, x) for x in sets[103]]
    pairs, members = sketch.banded_pairs(spark.createDataFrame(rows, "label int, genome bigint, gram bigint"), 5, 95.0)
    assert {(r.label, r.genome): r.rep for r in members.collect() if r.genome >= 2000} == {(1, 2000 + i): 103 for i in range(40)} | {(2, 5000): 5000}
    want = set()
    for a, b in combinations(sorted(g for g in sets if g < 2000), 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j and 100 * (1 + log(2 * j / (1 + j)) / 5) >= 95:
            want.add((1, a, b, len(sets[a] & sets[b])))
    assert len(want) > 1500
    got = {(r.label, r.query, r.refer, r.shared) for r in pairs.collect()}
    assert got <= want
    assert len(got) >= 0.999 * len(want)


@pytest.mark.parametrize("broadcast", [0, index.BROADCAST_GRAMS])
def test_a_sample_is_sketched_once(spark, stored, broadcast):
    path, _ = stored
    seen = spark.sparkContext.accumulator(0)

    def of(x):
        seen.add(1)
        return (x,)

    sample = spark.createDataFrame(spark.sparkContext.parallelize(range(100), 2).map(of), "gram bigint")
    assert index.genomes_in_sample(index.open_index(spark, path), sample, broadcast=broadcast).count() == 4
    assert seen.value == 100


def test_banded_pairs_move_less_than_the_documents(spark):
    from helixmill.plans import catalog

    folder = "/root/testdata/sf0.01"
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = moved()
    assert catalog.QUERIES["gr20_banded_pairs"](spark, folder).count() > 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert moved() - before < os.path.getsize(f"{folder}/documents.parquet")


def test_whole_sketches_of_genomes_with_several_rows(spark):
    from helixmill.operators import sketch

    rows = [("a", 1, [1, 2, 2]), ("a", 1, [3]), ("a", 2, [1, 2, 3]), ("b", 1, [4]), ("b", 3, []), ("b", 4, None), (None, 5, [1]), ("a", None, [1])]
    held = sketch.packed(spark.createDataFrame(rows, "label string, genome bigint, grams array<bigint>"))
    assert {(r.label, r.genome): sorted(r.grams) for r in held.collect() if r.grams} == {("a", 1): [1, 2, 3], ("a", 2): [1, 2, 3], ("b", 1): [4]}
    pairs, members = sketch.banded_pairs(held, 5, 95.0)
    assert {(r.label, r.genome): r.rep for r in members.collect()} == {("a", 1): 1, ("a", 2): 1, ("b", 1): 1}
    assert pairs.count() == 0
