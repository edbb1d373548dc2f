"""File formats there and back."""

import gzip

import pytest
from pyspark.sql import functions as F

from helixmill.operators import classify, seqstats, sketch
from helixmill.sources import fasta, gaf, graphs, sinks, tables


def test_gaf(spark, tmp_path):
    lines = ["@comment", "r1\t150\t0\t150\t+\t>1>2\t9\t1\t5\t4\t4\t60\tx", "r2\t150\t0\t150\t+\t*\t*\t*\t*\t4\t4\t0\tx", 'r"3\tbad\t0\t1\t+\t>1\t9\t1\t5\t4\t4\t7']
    (tmp_path / "a.gaf").write_text("\n".join(lines))
    got = {r.read_id: r for r in gaf.read_gaf(spark, str(tmp_path / "a.gaf")).collect()}
    assert set(got) == {"r1", "r2", 'r"3'}
    assert (got["r1"].path, got["r1"].read_start, got["r1"].mapq) == (">1>2", 1, 60)
    assert got["r2"].path is None
    assert got["r2"].read_start is None
    assert got['r"3'].read_len is None
    assert gaf.zero_for_bad(gaf.read_gaf(spark, str(tmp_path / "a.gaf"))).filter("read_id = 'r\"3'").first().read_len == 0


def test_long_gaf_best(spark, tmp_path):
    def line(name, matches, mapq, end, identity):
        return f"{name}\t9\t0\t{end}\t+\t>1\t9\t1\t5\t{matches}\t4\t{mapq}\ta\tb\tc\tid:f:{identity}"

    rows = [line("r", 900, 60, 1500, 0.99), line("r", 950, 10, 2000, 0.9), line("s", 5, 30, 1200, 0.5), "s\tshort", line("t", "x", 60, 1500, 0.9)]
    (tmp_path / "a.gaf").write_text("\n".join(rows))
    found = classify.best_alignments(gaf.read_long_gaf(spark, str(tmp_path / "a.gaf")))
    assert [r.read_id for r in found.collect()] == ["s"]
    sinks.write_lines(found.select(F.col("line").alias("value")), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1


def test_gfa(spark, tmp_path):
    text = "H\tVN:Z:1.1\nS\t11\tACG\nS\t12\tAC\nS\t13\tA\nL\t11\t+\t12\t+\t0M\nW\th1\t0\tc\t0\t5\t>11>12\nW\th1\t0\tc\t0\t5\t<13<12\nP\th2#1#c\t11+,13+\t*\n"
    (tmp_path / "sp.gfa").write_text(text)
    nodes, walks = graphs.read_gfa(spark, str(tmp_path / "sp.gfa"), first_node=10)
    assert sorted(tuple(r) for r in nodes.collect()) == [("sp", 1, 3), ("sp", 2, 2), ("sp", 3, 1)]
    got = {}
    for r in walks.orderBy("pos").collect():
        got.setdefault(r.hap_id, []).append(r.node_id)
    assert got == {"h1": [1, 2, 2, 3], "h2": [1, 3]}
    assert tuple(graphs.graph_ranges(nodes, walks).first()) == ("sp", 1, 3, 1)
    graphs.write_graph(nodes, str(tmp_path / "store"))
    assert graphs.read_graph(spark, str(tmp_path / "store"), ["sp"]).count() == 3
    assert graphs.read_graph(spark, str(tmp_path / "store"), ["other"]).count() == 0


@pytest.mark.parametrize("packed", [False, True])
def test_fasta(spark, tmp_path, packed):
    text = ">c1 some words\nACGT\nnn\n>c2\nGGG\n"
    path = tmp_path / ("GCF_1.1_x_genomic.fna" + (".gz" if packed else ""))
    with gzip.open(path, "wt") if packed else open(path, "w") as f:
        f.write(text)
    seqs = fasta.read_fasta(spark, str(path))
    assert sorted((r.seq_id, r.seq) for r in seqs.collect()) == [("c1", "ACGTnn"), ("c2", "GGG")]
    lines = sorted(r.value for r in fasta.merged_lines(seqs).collect())
    assert lines[0].startswith(">GCF_1.1#0#c1\nACGTNN")
    stats = seqstats.sequence_stats(seqs.withColumnRenamed("file", "genome")).first()
    assert (stats.n, stats.total, stats.gap, stats.n50) == (2, 9, 2, 6)
    assert stats.gc == pytest.approx(100 * 5 / 7)
    assert fasta.long_scaffolds(seqs, 4).count() == 1


def test_linear_graph(spark):
    seqs = spark.createDataFrame([("g", "c", "A" * 2500), ("g", "e", "")], "genome string, seq_id string, seq string")
    assert [r.node_len for r in seqstats.chunked(seqs).orderBy("node_id").collect()] == [1024, 1024, 452]
    lines = [r.value for r in seqstats.linear_gfa(seqs).filter("seq_id = 'c'").orderBy("part", "ord").collect()]
    assert [x[0] for x in lines] == ["H", "S", "S", "S", "L", "L", "W"]
    assert lines[-1].endswith(">1>2>3")


def test_tables(spark, tmp_path):
    (tmp_path / "info.tsv").write_text("genome_ID\tstrain_taxid\tspecies_taxid\torganism_name\tid\nG\t24.10\t24\tE coli\t/x/G.fna\nshort\t1\n")
    info = tables.genomes_info(spark, str(tmp_path / "info.tsv")).orderBy("genome_ID").collect()
    assert info[0].strain_taxid == "24.10"
    (tmp_path / "range.tsv").write_text("A\t1\t6\t1\nB\t7\t9\t0\n")
    assert [r.end for r in tables.species_range(spark, str(tmp_path / "range.tsv")).orderBy("start").collect()] == [6, 9]
    (tmp_path / "m.txt").write_text("3\na\nb\t97\nc\t95\t90\n")
    cells = {(r.i, r.j): r.dist for r in tables.ani_matrix(spark, str(tmp_path / "m.txt")).collect()}
    assert len(cells) == 9
    assert (cells["a", "a"], cells["a", "b"], cells["b", "a"], cells["c", "b"]) == (0, 3, 3, 10)
    (tmp_path / "ani.tsv").write_text("a\tb\t99.5\t1\t2\n")
    assert tuple(tables.ani_pairs(spark, str(tmp_path / "ani.tsv")).first()) == ("a", "b", 99.5)
    (tmp_path / "stats.tsv").write_text("f\t1\t9\t0\t9\t9\t9\t9\t9\t50\ng\t1\t9\t10000000\t9\t9\t9\t9\t9\t50\nh\t1\t9\t0\t9\t0\t9\t9\t9\t50\n")
    assert [r.file for r in tables.genome_stats(spark, str(tmp_path / "stats.tsv")).collect()] == ["f"]


def test_metadata(spark, tmp_path):
    def row(n, **fields):
        return "\t".join(fields.get(f"f{i}", "x") for i in range(n))

    lines = ["# comment", row(22, f4="reference genome", f5="1", f6="2", f11="Complete Genome", f19="ftp://h/GCF_1_A"), row(22, f6="3", f11="Contig", f19="ftp://h/GCF_2_B")]
    (tmp_path / "summary.txt").write_text("\n".join(lines))
    every = tables.assembly_summary(spark, str(tmp_path / "summary.txt"))
    assert every.count() == 2
    one = tables.assembly_summary(spark, str(tmp_path / "summary.txt"), "Complete Genome", ["2"]).first()
    assert (one.file, one.is_ref) == ("GCF_1_A_genomic.fna", True)
    listing = spark.createDataFrame([("file:/d/GCF_2_B_genomic.fna.gz",)], "path string")
    assert [r.species_taxid for r in tables.existing_files(every, listing).collect()] == ["3"]
    (tmp_path / "gtdb.tsv").write_text(row(70, f0="accession") + "\n" + row(70, f0="RS_GCF_1.1", f19="d__B;s__E coli", f48="Complete Genome"))
    got = tables.gtdb_metadata(spark, str(tmp_path / "gtdb.tsv")).first()
    assert (got.accession, got.species) == ("GCF_1.1", "E_coli")


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("A", 0.126, 1.0)], "species_taxid string, predicted_abundance double, predicted_coverage double")
    sinks.write_species_report(df, str(tmp_path / "s"))
    assert tables.species_abundance(spark, str(tmp_path / "s")).first().predicted_abundance == 0.126
    sinks.write_strain_report(df, str(tmp_path / "t"), digits=2)
    assert tables.species_abundance(spark, str(tmp_path / "t")).first().predicted_abundance == 0.13
    reads = spark.createDataFrame([("r", 60, "A", 150, 1)], "read_id string, mapq int, species string, read_len int, other int")
    sinks.write_read_report(reads, str(tmp_path / "r"))
    assert tables.read_classes(spark, str(tmp_path / "r")).first().species == "A"
    assert tables.list_files(spark, str(tmp_path / "r"), "part-*").count() >= 1


def test_sketch(spark):
    items = spark.createDataFrame([(1, "ACGTACGTAA"), (2, "TTTTTTTTTT"), (3, "A")], "item_id int, seq string")
    reads = spark.createDataFrame([("CCACGTACGTAACC",)], "seq string")
    kmers = sketch.sketched(items, sketch.letter_grams(F.col("seq"), 5))
    known = sketch.sketched(reads, sketch.letter_grams(F.col("seq"), 5))
    got = {r.item_id: (r.containment, r.ani) for r in sketch.containment(kmers, known, k=5).collect()}
    assert got == {1: (1.0, 100.0), 2: (0.0, 0.0)}
    assert sketch.sketched(items, sketch.letter_grams(F.col("seq"), 5), scale=2).count() < kmers.count()


def test_stream(spark, tmp_path):
    from helixmill.streaming.profile import stream_reads, stream_species_bases

    spark.createDataFrame([("a", ">1", 60, 100), ("b", ">9", 60, 50)], "rid string, path string, mapq int, read_len bigint").write.parquet(str(tmp_path / "in"))
    held = spark.createDataFrame([("A", 1, 5)], "species string, start bigint, end bigint")
    q = stream_species_bases(stream_reads(spark, str(tmp_path / "in"), "rid string, path string, mapq int, read_len bigint"), held, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [(r.species, r.bases) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("A", 100)]


def test_grams_are_the_plain_ones(spark):
    import random

    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 3, 4, 5, 255, 256, 257, 259, 260, 1500)]
    df = spark.createDataFrame([(i, s, " ".join(s[:40])) for i, s in enumerate(seqs)], "i int, seq string, text string")
    for r in df.select("seq", "text", sketch.letter_grams(F.col("seq"), 5).alias("g"), sketch.word_grams(F.col("text"), 3).alias("w")).collect():
        assert set(r.g) == {r.seq[k : k + 5] for k in range(len(r.seq) - 4)}
        words = r.text.split(" ")
        assert set(r.w) == {" ".join(words[k : k + 3]) for k in range(len(words) - 2)}
        assert len(r.g) == len(set(r.g))


def test_headers_may_hold_the_sign_of_a_record(spark, tmp_path):
    (tmp_path / "a.fna").write_text(">c1 a->b >c\nAC>GT\n>c2\n\nGG\r\nG\n\n>c3 empty\n")
    assert sorted((r.seq_id, r.seq) for r in fasta.read_fasta(spark, str(tmp_path / "a.fna")).collect()) == [("c1", "AC>GT"), ("c2", "GGG"), ("c3", "")]


def test_node_ids_must_be_consecutive(spark, tmp_path):
    (tmp_path / "good.gfa").write_text("S\t1\tA\nS\t2\tC\n")
    assert graphs.check_consecutive(graphs.read_gfa(spark, str(tmp_path / "good.gfa"))[0]).count() == 2
    for lines in ("S\t1\tA\nS\t3\tC\n", "S\t2\tA\nS\t3\tC\n", "S\t1\tA\nS\t1\tC\n"):
        (tmp_path / "bad.gfa").write_text(lines)
        with pytest.raises(ValueError, match="bad"):
            graphs.check_consecutive(graphs.read_gfa(spark, str(tmp_path / "*.gfa"))[0])


def test_a_walk_of_a_large_file_follows_its_lines(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = [f"S\t{i}\tA" for i in range(1, 1001)] + [f"W\th\t0\tc{i}\t0\t2\t>{i}>{i + 1}" for i in range(1, 1000, 2)]
        (tmp_path / "sp.gfa").write_text("\n".join(lines))
        nodes, walks = graphs.read_gfa(spark, str(tmp_path / "sp.gfa"))
        assert nodes.rdd.getNumPartitions() > 3
        assert [r.node_id for r in walks.orderBy("pos").collect()] == list(range(1, 1001))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_exactly_one_file(spark, tmp_path):
    for name in ("a.gfa", "b.gfa", "c.txt"):
        (tmp_path / name).write_text("x")
    assert tables.only_file(spark, str(tmp_path), "*.txt").endswith("c.txt")
    for pattern in ("*.gfa", "*.bin"):
        with pytest.raises(ValueError):
            tables.only_file(spark, str(tmp_path), pattern)


def test_similarity_files_are_packed_and_not_copied(spark):
    from helixmill.operators import cut
    from helixmill.plans import catalog

    cut.remove_cuts(spark)
    frame = catalog.QUERIES["sc17_ani_pairs"](spark, "/root/testdata/sf0.001")
    assert frame.count() > 0
    names = [r.path for p in cut._written for r in tables.list_files(spark, p, "part-*").collect()]
    assert len(cut._written) == 1 and names and all(x.endswith(".txt.gz") for x in names)
