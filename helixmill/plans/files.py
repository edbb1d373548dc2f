"""Sources and sinks as queries: bound tables are written in each format, read back and returned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators import classify, seqstats, species
from helixmill.operators.cut import scratch_path, settled
from helixmill.plans import bindings as b
from helixmill.sources import fasta, gaf, graphs, sinks, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    """Register a query; the files that it writes on the way are deleted once its rows are written."""
    QUERIES[f.__name__] = lambda s, d: settled(s, lambda: f(s, d))
    return f


def streamed(f):
    """Register a query whose rows are read from the files that it wrote last as they are asked for; these stay."""
    QUERIES[f.__name__] = lambda s, d: settled(s, lambda: f(s, d), made=False)
    return f


def _path(s) -> str:
    return scratch_path(s, "files")


def _lines(s, frame: DataFrame, value, **options) -> str:
    path = _path(s)
    sinks.write_lines(frame.select(value.alias("value")), path, **options)
    return path


def _tabbed(*fields):
    return F.concat_ws("\t", *[f if isinstance(f, str) else f.cast("string") for f in fields])


def _info(s, d) -> DataFrame:
    """genome_ID, strain_taxid (24.10 is not 24.1), species_taxid, organism_name, id"""
    return b.table(s, d, "part").selectExpr(
        "concat('GCF_', p_partkey) as genome_ID", "concat(p_partkey div 100, '.', p_partkey % 100, '0') as strain_taxid",
        "cast(p_partkey div 100 as string) as species_taxid", "p_name as organism_name", "concat('/g/GCF_', p_partkey, '.fna') as id",
    )


@query
def sc1_sk10_genomes_info(s, d):
    path = _path(s)
    sinks.write_tsv(_info(s, d), path)
    return tables.genomes_info(s, path)


@query
def sc2_species_range(s, d):
    path = _path(s)
    sinks.write_tsv(b.ranges(s, d).select("species", "start", "end", "is_pan"), path, header=False)
    return tables.species_range(s, path)


def _gaf_lines(s, d) -> str:
    """Alignment lines, one in seven without a path, one in eleven with a length that is no number, and comments."""
    r = b.reads(s, d).withColumn("k", F.pmod(F.col("read_end"), F.lit(77)))
    path = F.when(F.col("k") % 7 == 0, F.lit("*")).otherwise(F.col("path"))
    length = F.when(F.col("k") % 11 == 0, F.lit("bad")).otherwise(F.col("read_len").cast("string"))
    line = _tabbed("rid", length, F.lit("0"), F.col("span"), F.lit("+"), path, F.lit("9"), F.col("read_start"), F.col("read_end"), F.col("matches"), F.lit("4"), F.col("mapq"), F.lit("x"))
    comments = s.range(3).select(F.concat(F.lit("@comment "), "id").alias("value"))
    return _lines(s, r.select(line.alias("value")).union(comments), F.col("value"))


@query
def sc3_gaf(s, d):
    return gaf.read_gaf(s, _gaf_lines(s, d))


@query
def sc4_gaf_columns(s, d):
    return gaf.read_gaf(s, _gaf_lines(s, d)).select("read_id", "path", "mapq", "read_len")


@query
def sc5_gaf_zero(s, d):
    return gaf.zero_for_bad(gaf.read_gaf(s, _gaf_lines(s, d)))


def _long_lines(s, d) -> str:
    line = _tabbed("read_id", F.lit("9"), F.lit("0"), F.col("span"), F.lit("+"), "path", F.lit("9"), F.col("read_start"), F.col("read_end"), F.col("matches"), F.lit("4"), F.col("mapq"), "rid", F.lit("b"), F.lit("c"), F.concat(F.lit("id:f:"), "identity"))
    r = b.reads(s, d).select(line.alias("value"))
    short = b.reads(s, d).filter("mapq = 7").select(F.concat("read_id", F.lit("\tshort")).alias("value"))
    return _lines(s, r.union(short), F.col("value"))


@query
def sc6_long_gaf(s, d):
    return gaf.read_long_gaf(s, _long_lines(s, d)).select(F.element_at(F.split("line", "\t"), 13).alias("rid"), "read_id", "mapq", "matches", F.round("identity", 6).alias("identity"), "span")


@query
def sk9_filtered_gaf(s, d):
    """Best alignments, written as the lines they came from."""
    best = classify.best_alignments(gaf.read_long_gaf(s, _long_lines(s, d)))
    again = gaf.read_long_gaf(s, _lines(s, best, F.col("line")))
    return again.select("read_id", "mapq", "matches", F.round("identity", 6).alias("identity"), "span")


@query
def sc7_species_lengths(s, d):
    path = _path(s)
    sinks.write_tsv(b.lengths(s, d), path, header=False)
    return tables.species_lengths(s, path)


def _classified(s, d):
    return classify.classify_by_range(b.reads(s, d), b.ranges(s, d))


@query
def sc8_sk2_read_classes(s, d):
    path = _path(s)
    sinks.write_read_report(_classified(s, d), path)
    return tables.read_classes(s, path)


def _profile(s, d):
    return species.species_profile(species.species_bases(_classified(s, d)), b.lengths(s, d))


@query
def sc9_sk3_species_report(s, d):
    path = _path(s)
    sinks.write_species_report(_profile(s, d), path)
    return tables.species_abundance(s, path).select("species_taxid", *[F.round(c, 9).alias(c) for c in ("predicted_abundance", "predicted_coverage")])


@query
def sk5_rounded_report(s, d):
    path = _path(s)
    sinks.write_strain_report(_profile(s, d), path, digits=2)
    return tables.species_abundance(s, path)


def _graph_files(s, d, back: bool = False) -> str:
    """Node and walk lines by species; node ids are local, walks of odd haplotypes may be written backwards."""
    n = b.nodes(s, d).withColumn("local", F.expr("row_number() over (partition by species order by node_id)"))
    seq = F.expr("repeat('A', cast(node_len as int))")
    s_lines = n.select("species", F.lit(0).alias("k"), F.col("local").cast("bigint").alias("at"), _tabbed(F.lit("S"), F.col("local"), seq).alias("value"))
    w = b.walks(s, d).join(n.select("species", "node_id", "local"), ["species", "node_id"])
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "local"))), lambda x: x.getField("local").cast("string"))
    walks = w.groupBy("species", "hap_id").agg(ids.alias("ids"))
    odd = F.substring("hap_id", 2, 1).cast("int") % 2 == 1
    steps = F.concat(F.lit(">"), F.array_join("ids", ">"))
    if back:
        steps = F.when(odd, F.concat(F.lit("<"), F.array_join(F.reverse("ids"), "<"))).otherwise(steps)
    w_lines = walks.select("species", F.lit(1).alias("k"), F.lit(0).cast("bigint").alias("at"), _tabbed(F.lit("W"), "hap_id", F.lit("0"), F.lit("c"), F.lit("0"), F.lit("9"), steps).alias("value"))
    path = _path(s)
    every = s_lines.union(w_lines).repartition("species").sortWithinPartitions("species", "k", "at")
    every.select("species", "value").write.partitionBy("species").text(path)
    return f"{path}/species=*"


def _split_walks(s, d) -> str:
    """Node and walk lines by species; a walk takes a line for every five steps, and haplotypes' lines are mixed."""
    n = b.nodes(s, d).withColumn("local", F.expr("row_number() over (partition by species order by node_id)"))
    s_lines = n.select("species", F.lit(-1).cast("bigint").alias("at"), F.lit("").alias("hap_id"), _tabbed(F.lit("S"), F.col("local"), F.expr("repeat('A', cast(node_len as int))")).alias("value"))
    w = b.walks(s, d).join(n.select("species", "node_id", "local"), ["species", "node_id"])
    few = w.groupBy("species", "hap_id", F.expr("cast(pos div 5 as bigint)").alias("at")).agg(F.array_sort(F.collect_list(F.struct("pos", "local"))).alias("five"))
    steps = F.concat(F.lit(">"), F.array_join(F.transform("five", lambda x: x.getField("local").cast("string")), ">"))
    w_lines = few.select("species", "at", "hap_id", _tabbed(F.lit("W"), "hap_id", F.lit("0"), F.lit("c"), F.lit("0"), F.lit("9"), steps).alias("value"))
    path = _path(s)
    s_lines.union(w_lines).repartition("species").sortWithinPartitions("species", "at", "hap_id").select("species", "value").write.partitionBy("species").text(path)
    return f"{path}/species=*"


def _steps(walks: DataFrame) -> DataFrame:
    return walks.select("species", "hap_id", "pos", "node_id")


@query
def sc10_gfa_nodes(s, d):
    nodes, _ = graphs.read_gfa(s, _graph_files(s, d))
    return graphs.check_consecutive(nodes)


@query
def sc10_gfa_walks(s, d):
    return _steps(graphs.read_gfa(s, _graph_files(s, d), orient=False)[1])


@query
def sc10_long_walks(s, d):
    return _steps(graphs.read_gfa(s, _split_walks(s, d), orient=False)[1])


@query
def sc11_gfa_oriented(s, d):
    return _steps(graphs.read_gfa(s, _graph_files(s, d, back=True))[1])


@query
def sc11_graph_ranges(s, d):
    return graphs.graph_ranges(*graphs.read_gfa(s, _graph_files(s, d)))


@query
def sc12_sk7_stored_graph(s, d):
    path = _path(s)
    graphs.write_graph(b.nodes(s, d), path)
    return graphs.read_graph(s, path, ["S1", "S3", "S4"])


@query
def rg4_merge_graphs(s, d):
    nodes = b.nodes(s, d)
    return graphs.merge_graphs([nodes, nodes.filter("species in ('S1', 'S2')").withColumn("node_len", F.col("node_len") + 1)])


@query
def sc13_sk11_fasta(s, d):
    """Merged sequences, gzipped; headers hold a > of their own."""
    seqs = b.sequences(s, d).select(F.concat("genome", F.lit("_x_genomic.fna")).alias("file"), F.concat(F.col("seq_id"), F.lit(" a->b")).alias("seq_id"), F.md5("seq").alias("seq"))
    return fasta.read_fasta(s, _lines(s, fasta.merged_lines(seqs), F.col("value"), compression="gzip")).select("seq_id", "seq")


@query
def sk8_linear_gfa(s, d):
    seqs = b.sequences(s, d).filter("seq_id % 10 = 0").select("genome", "seq_id", F.regexp_replace("seq", "[^a-z]", "a").alias("seq"))
    lines = s.read.text(_lines(s, seqstats.linear_gfa(seqs), F.col("value")))
    return lines.groupBy(F.substring("value", 1, 1).alias("kind")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("value")).alias("chars"))


def _wide(fields: dict, width: int):
    """A line of so many fields, those not given an x."""
    return _tabbed(*[fields.get(i, F.lit("x")) for i in range(width)])


@query
def sc15_assembly_summary(s, d):
    part = b.table(s, d, "part")
    kind = F.when(F.col("p_size") % 5 == 0, F.lit("reference genome")).otherwise(F.lit("na"))
    level = F.when(F.col("p_size") % 2 == 0, F.lit("Complete Genome")).otherwise(F.lit("Contig"))
    fields = {4: kind, 5: F.col("p_partkey"), 6: F.expr("p_partkey div 100"), 7: F.col("p_name"), 11: level, 19: F.concat(F.lit("ftp://h/GCF_"), "p_partkey")}
    lines = part.select(_wide(fields, 22).alias("value")).union(s.range(2).select(F.lit("# comment").alias("value")))
    rows = tables.assembly_summary(s, _lines(s, lines, F.col("value")), "Complete Genome", ["1", "2", "3"])
    listing = part.filter("p_partkey % 3 = 0").select(F.concat(F.lit("file:/d/GCF_"), "p_partkey", F.lit("_genomic.fna.gz")).alias("path"))
    return tables.existing_files(rows, listing)


@query
def sc16_gtdb(s, d):
    part = b.table(s, d, "part")
    fields = {0: F.concat(F.lit("RS_GCF_"), "p_partkey"), 19: F.concat(F.lit("d__B;p__P;s__"), "p_name"), 48: F.lit("Complete Genome"), 49: F.concat(F.lit("A"), F.col("p_size")), 65: F.col("p_name")}
    head = s.range(1).select(_wide({0: F.lit("accession")}, 70).alias("value"))
    return tables.gtdb_metadata(s, _lines(s, head.union(part.select(_wide(fields, 70))), F.col("value")))


@streamed
def sc17_ani_pairs(s, d):
    sim = b.similarities(s, d, 10.0)
    return tables.ani_pairs(s, _lines(s, sim, _tabbed(F.col("query"), F.col("refer"), F.col("ani"), F.lit("1"), F.lit("2")), compression="gzip"))


@query
def sc18_ani_matrix(s, d):
    n = b.table(s, d, "nation").select("n_nationkey", "n_name")
    sims = F.transform(F.filter(F.sequence(F.lit(0), F.col("n_nationkey")), lambda j: j < F.col("n_nationkey")), lambda j: (50 + (F.col("n_nationkey") * 7 + j * 3) % 50).cast("string"))
    rows = n.select(F.col("n_nationkey").cast("int").alias("at"), F.concat_ws("\t", F.translate("n_name", " ", "_"), sims).alias("value"))
    head = n.agg(F.lit(-1).alias("at"), F.count(F.lit(1)).cast("string").alias("value"))
    path = _path(s)
    head.union(rows).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    return tables.ani_matrix(s, path)


@query
def sc20_genome_stats(s, d):
    part = b.table(s, d, "part")
    line = _tabbed(F.col("p_name"), F.col("p_partkey"), F.lit("9"), F.expr("p_size * 500000"), F.lit("1.5"), F.expr("p_partkey % 4"), F.lit("1"), F.lit("2"), F.lit("3"), F.lit("50.0"))
    return tables.genome_stats(s, _lines(s, part, line)).select("n", "gap", "n50")


@query
def sc21_listing(s, d):
    """The one part file of each report; its name is Spark's, so its length is told."""
    path = _path(s)
    sinks.write_species_report(b.ranges(s, d).select("species", "start"), path)
    return tables.list_files(s, path, "*.csv").filter(F.col("path") == tables.only_file(s, path, "*.csv")).select("length")


@query
def jn11_with_info(s, d):
    chosen = b.table(s, d, "part").selectExpr("concat('GCF_', p_partkey + 50) as genome_ID", "p_size as n50")
    return tables.with_info(chosen, _info(s, d))


@query
def pf13_in_set(s, d):
    return tables.in_set(_info(s, d), b.table(s, d, "part").filter("p_size > 25").selectExpr("concat('GCF_', p_partkey) as genome_ID"))
