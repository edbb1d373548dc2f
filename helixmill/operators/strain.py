"""Strain filters, constraints and the strain table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.operators import coverage as cov
from helixmill.operators import lad
from helixmill.operators.cut import cut

# Parameter defaults.
MIN_FRACTION, MAX_DIVERGENCE, RESCUE_DIVERGENCE, RESCUE_SHARE = 0.3, 0.46, 0.6, 0.85
Z_LIMIT, OVERSHOOT, SINGLE_COV_DIFF, SHIFT_CAP = 3.0, 1.05, 0.2, 0.8
SAMPLE_NODES = 500_000


def trimmed_mean(rows: DataFrame, keys: list[str], value: str, limit: float = Z_LIMIT) -> DataFrame:
    """Mean of the values within ``limit`` population deviations of their mean; 0 where there are none or all are equal."""
    group = Window.partitionBy(*keys)
    scored = rows.withColumn("_mean", F.avg(value).over(group)).withColumn("_std", F.stddev_pop(value).over(group))
    kept = F.when((F.col("_std") > 1e-12) & (F.abs(F.col(value) - F.col("_mean")) < limit * F.col("_std")), F.col(value))
    return scored.groupBy(*keys).agg(F.coalesce(F.avg(kept), F.lit(0.0)).alias("mean"))


def shift_threshold(mean: Column, fraction: float) -> Column:
    """The share of triples asked for, by the depth: more for deeper haplotypes."""
    deep = F.least(F.lit(SHIFT_CAP), fraction + (SHIFT_CAP - fraction) * mean / 100)
    return F.when(mean >= 1, deep).otherwise(fraction * mean)


def first_filter(depths: DataFrame, fraction: float = MIN_FRACTION, shift: bool = False) -> DataFrame:
    """(species, hap_id, fraction, mean, keep) of the haplotypes with unique triples (species, hap_id, depth).

    ``fraction`` is the share of triples with depth, told with two decimals but compared in full.
    """
    shares = depths.groupBy("species", "hap_id").agg(F.count_if(F.col("depth") > 0).alias("_hit"), F.count(F.lit(1)).alias("_all"))
    means = trimmed_mean(depths.filter("depth > 0"), ["species", "hap_id"], "depth")
    both = shares.join(means, ["species", "hap_id"], "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    share = F.col("_hit") / F.col("_all")
    least = shift_threshold(F.col("mean"), fraction) if shift else F.lit(fraction)
    return both.select("species", "hap_id", F.round(share, 2).alias("fraction"), "mean", (share >= least).alias("keep"))


def degenerate_filter(walks: DataFrame, depth: DataFrame, unique: DataFrame, min_depth: float = 0.0) -> DataFrame:
    """(species, hap_id, mean) for species of one haplotype or without unique triples.

    One haplotype, or the first of identical ones, stays with the mean positive node depth in two decimals; different
    ones without unique triples all stay, without a mean. Depths up to ``min_depth`` count as none.
    """
    paths = walks.groupBy("species", "hap_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("_p"))
    paths = paths.withColumn("_p", F.transform("_p", lambda x: x.getField("node_id")))
    per = paths.groupBy("species").agg(F.count(F.lit(1)).alias("_haps"), F.count_distinct(F.xxhash64("_p")).alias("_paths"), F.min("hap_id").alias("_first"))
    positive = F.when(F.col("depth") > min_depth, F.col("depth"))
    means = depth.groupBy("species").agg(F.round(F.avg(F.when(positive > 0, positive)), 2).alias("_mean"))
    rest = per.join(unique.select("species").distinct(), "species", "left").join(means, "species", "left")
    without = per.join(unique.select("species").distinct(), "species", "left_anti").select("species").withColumn("_none", F.lit(True))
    rest = per.join(without, "species", "left").join(means, "species", "left").filter(F.col("_none") | (F.col("_haps") == 1))
    single = (F.col("_haps") == 1) | (F.col("_paths") == 1)
    out = paths.select("species", "hap_id").join(rest, "species").filter(~single | (F.col("hap_id") == F.col("_first")))
    return out.select("species", "hap_id", F.when(single, F.coalesce("_mean", F.lit(0.0))).alias("mean"))


def second_filter(metrics: DataFrame) -> DataFrame:
    """Verdict on first solutions: (species, hap_id, fraction, mean, path_base_cov, first_sol) with divergence, keep and is_rescue.

    A haplotype stays if its solution is near its triples' mean, or, somewhat further, if nearly all of it is covered.
    """
    gap = F.round(F.try_divide(F.abs(F.col("first_sol") - F.col("mean")), F.col("first_sol") + F.col("mean")), 2)
    near = F.col("divergence") <= MAX_DIVERGENCE
    covered = F.col("fraction") * F.col("path_base_cov") >= RESCUE_SHARE
    rescue = ~near & (F.col("divergence") <= RESCUE_DIVERGENCE) & covered
    some = (F.col("mean") != 0) & (F.col("first_sol") != 0)
    judged = metrics.withColumn("divergence", F.when(F.col("mean") != 0, gap))
    return judged.withColumn("keep", F.coalesce(some & (near | rescue), F.lit(False))).withColumn("is_rescue", F.coalesce(some & rescue, F.lit(False)))


def second_solution_as_first(metrics: DataFrame, single: bool) -> DataFrame:
    """Where the second filter doesn't apply the first solution stands; of a single path only if its mean is positive."""
    return metrics.withColumn("second_sol", F.when(F.col("mean") > 0, F.col("first_sol")) if single else F.col("first_sol"))


def sample_nodes(depth: DataFrame, most: int = SAMPLE_NODES) -> DataFrame:
    """The rows of nodes with depth, in a species with over ``most`` of them the ``most`` first by a hash of the node id.

    Only nodes below a bound on the hash, somewhat above the share that is wanted, are ranked.
    """
    some = depth.filter("depth > 0").withColumn("_h", F.expr("(node_id * 48271 + 42) % 2147483647"))
    counts = some.groupBy("species").agg(F.count(F.lit(1)).alias("_n"))
    large = counts.filter(F.col("_n") > most)
    whole = some.join(large, "species", "left_anti")
    bound = F.lit(2147483647.0) * (2 * most + 1000) / F.col("_n")
    rank = F.row_number().over(Window.partitionBy("species").orderBy("_h", "node_id"))
    ranked = some.join(large, "species").filter(F.col("_h") < bound).withColumn("_r", rank).filter(F.col("_r") <= most)
    return whole.unionByName(ranked.drop("_r", "_n")).drop("_h")


def strain_metrics(reads: DataFrame, nodes: DataFrame, walks: DataFrame, coverage: DataFrame, fraction: float = MIN_FRACTION, shift: bool = False, min_depth: float = 0.0, sample: int = SAMPLE_NODES) -> DataFrame:
    """Per haplotype of the profiled species its measures and solutions, from classified reads to constraints.

    reads are classified alignments, nodes (species, node_id, node_len) and walks (species, hap_id, pos, node_id) the
    graphs, coverage (species, coverage) the species profile, whose species are the ones worked on. Returns (species,
    hap_id, fraction, mean, path_base_cov, first_sol, divergence, second_sol, is_rescue, total_cov_diff); haplotypes that
    a filter drops have no second_sol.

    Species of several haplotypes with unique triples go through both filters and are fitted twice. A species' only
    haplotype, or the first of identical ones, takes its one fit if it has depth, and different haplotypes without
    unique triples take theirs as they are.
    """
    keys = ["species", "hap_id"]
    known = coverage.filter("coverage is not null").select("species", "coverage")
    nodes, walks = (cut(x.join(known.select("species"), "species", "left_semi")) for x in (nodes, walks))
    node_sums, triple_sums = cov.read_sums(reads, nodes)
    depth = cut(cov.depth_of_sums(node_sums, nodes))
    unique = cut(cov.triple_haps(cov.unique_triples(cov.walk_triples(walks)), nodes))
    few = cut(degenerate_filter(walks, depth, unique, min_depth).select(*keys, F.lit(None).cast("double").alias("fraction"), "mean"))
    haps = walks.select(*keys).distinct()
    without = haps.groupBy("species").agg(F.count(F.lit(1)).alias("_haps")).join(unique.select("species").distinct().withColumn("_some", F.lit(True)), "species", "left")
    plain = cut(without.select("species", ((F.col("_haps") == 1) | F.col("_some").isNull()).alias("plain")))
    shares = first_filter(cov.triple_depth_of_sums(triple_sums, unique), fraction, shift).join(plain.filter("not plain"), "species", "left_semi")
    possible = few.union(shares.filter("keep").drop("keep"))
    used = sample_nodes(depth, sample)
    breadth = cov.path_breadth(walks, nodes, cov.breadth_of_sums(node_sums, nodes))

    def fitted(chosen: DataFrame, name: str) -> DataFrame:
        fit = lad.fit_species(walks.join(chosen.select(*keys), keys, "left_semi"), used).select(*keys, F.col("x").alias(name))
        return chosen.join(fit, keys, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))

    first = cut(fitted(possible.join(breadth, keys, "left"), "first_sol").join(plain, "species"))
    judged = cut(second_filter(first.filter("not plain")).drop("plain"))
    second = fitted(judged.filter("keep"), "second_sol")
    dropped = judged.filter("not keep").withColumn("second_sol", F.lit(None).cast("double"))
    single = second_filter(first.filter("plain and mean is not null")).withColumn("divergence", F.when(F.col("mean") > 0, F.col("divergence")))
    single = second_solution_as_first(single.withColumn("is_rescue", F.lit(False)), single=True)
    several = second_solution_as_first(first.filter("plain and mean is null").withColumn("divergence", F.lit(None).cast("double")).withColumn("is_rescue", F.lit(False)), single=False)
    columns = ["fraction", "mean", "path_base_cov", "first_sol", "divergence", "second_sol", "is_rescue"]
    solved = second.select(*keys, *columns)
    for part in (dropped, single, several):
        solved = solved.union(part.select(*keys, *columns))
    # Where the first filter dropped a haplotype its share of triples is all that is known.
    rest = shares.filter("not keep").select(*keys, F.col("fraction").alias("_f"))
    every = haps.join(solved, keys, "left").join(rest, keys, "left").withColumn("fraction", F.coalesce("fraction", "_f")).drop("_f")
    return constrain(every.withColumn("is_rescue", F.coalesce("is_rescue", F.lit(False))), known)


def strain_profile(reads: DataFrame, nodes: DataFrame, walks: DataFrame, coverage: DataFrame, genomes: DataFrame, min_cov: float = 0.0, single_cov_diff: float = SINGLE_COV_DIFF, digits: int | None = None, **options) -> DataFrame:
    """The strain report from classified reads, all species in one job: ``strain_metrics`` and ``strain_table``."""
    return strain_table(strain_metrics(reads, nodes, walks, coverage, **options), genomes, min_cov, single_cov_diff, digits)


def constrain(metrics: DataFrame, coverage: DataFrame) -> DataFrame:
    """Second solutions against the species' coverage (species, coverage): adds total_cov_diff and corrects second_sol.

    Rescued haplotypes take the smaller solution; if the largest is over 1.05 times the coverage, the others are scaled
    by coverage over their sum.
    """
    group = Window.partitionBy("species")
    both = metrics.join(coverage, "species", "left")
    both = both.withColumn("second_sol", F.when(F.col("is_rescue"), F.least("first_sol", "second_sol")).otherwise(F.col("second_sol")))
    both = both.withColumn("_sum", F.sum(F.coalesce("second_sol", F.lit(0.0))).over(group)).withColumn("_max", F.max("second_sol").over(group))
    both = both.withColumn("total_cov_diff", F.try_divide(F.abs(F.col("_sum") - F.col("coverage")), (F.col("_sum") + F.col("coverage")) / 2))
    scaled = F.col("second_sol") * F.try_divide("coverage", "_sum")
    over = (F.col("_max") > OVERSHOOT * F.col("coverage")) & ~F.col("is_rescue")
    return both.withColumn("second_sol", F.when(F.coalesce(over, F.lit(False)), scaled).otherwise(F.col("second_sol"))).drop("_sum", "_max", "coverage")


def _told(named: DataFrame) -> DataFrame:
    """The columns of the strain report, abundance as the share of all coverage."""
    total = named.agg(F.sum("second_sol")).scalar()
    shared = named.withColumn("predicted_abundance", F.try_divide(F.col("second_sol"), total))
    return shared.select(
        F.col("species").alias("species_taxid"), "strain_taxid", "genome_ID", F.col("second_sol").alias("predicted_coverage"), "predicted_abundance", "path_base_cov",
        F.col("fraction").alias("unique_trio_fraction"), F.col("mean").alias("uniq_trio_cov_mean"), "first_sol", F.col("divergence").alias("strain_cov_diff"), "total_cov_diff",
    )


def unfiltered_table(metrics: DataFrame, genomes: DataFrame) -> DataFrame:
    """All haplotypes with their measures, dropped ones too, before any filter of the report."""
    return _told(metrics.join(genomes, "hap_id", "left"))


def strain_table(metrics: DataFrame, genomes: DataFrame, min_cov: float = 0.0, single_cov_diff: float = SINGLE_COV_DIFF, digits: int | None = None) -> DataFrame:
    """The strain report: metrics with genome ids (hap_id, strain_taxid, genome_ID), filtered, abundances renormalised.

    Abundance is the share of all coverage. A species' only haplotype needs a total difference within the limit.
    """
    named = metrics.join(genomes, "hap_id", "left")
    size = F.count("hap_id").over(Window.partitionBy("species"))
    kept = named.withColumn("_size", size).filter((F.col("_size") > 1) | (F.col("total_cov_diff") <= single_cov_diff))
    out = _told(kept.filter((F.col("second_sol") >= min_cov) & (F.col("second_sol") != 0)))
    if digits is not None:
        out = out.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in out.dtypes])
    return out.orderBy(F.desc("predicted_abundance"), "species_taxid", "strain_taxid")
