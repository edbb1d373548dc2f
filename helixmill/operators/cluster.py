"""Redundant genomes: similarity graphs, components, cliques, linkage and representatives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.operators.cliques import best_cliques
from helixmill.operators.cut import cut
from helixmill.operators.pairs import forest
from helixmill.shipping import ensure_shipped

WEAK_ANI, STRONG_ANI = 95.0, 99.9
#: Genomes up to this many are broadcast to their pairs, and only after a count: pairs are many more.
BROADCAST_GENOMES = 500_000


def beside_pairs(genomes: DataFrame) -> DataFrame:
    """Rows by genome, broadcast if they are few, so that pairs needn't move."""
    return F.broadcast(genomes) if genomes.limit(BROADCAST_GENOMES + 1).count() <= BROADCAST_GENOMES else genomes


def _both_ways(edges: DataFrame) -> DataFrame:
    """Each pair from either side, read once."""
    sides = F.array(F.struct("query", "refer"), F.struct(F.col("refer").alias("query"), F.col("query").alias("refer")))
    return edges.select("label", F.explode(sides).alias("_s"), "ani").select("label", "_s.query", "_s.refer", "ani")


def pair_max(edges: DataFrame) -> DataFrame:
    """(label, query, refer, ani) with each unordered pair once, at its largest value; self pairs go."""
    pair = [F.least("query", "refer").alias("query"), F.greatest("query", "refer").alias("refer")]
    return edges.filter("query <> refer").groupBy("label", *pair).agg(F.max("ani").alias("ani"))


#: Edges that a task joins to trees before rounds over all edges; many more take many tasks.
TREE_EDGES = 1_000_000


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) -> an edge (smallest, b) for each other node b of a tree that they make."""
    held = [(np.asarray(x.column(0), np.int64), np.asarray(x.column(1), np.int64)) for x in batches if x.num_rows]
    if held:
        names, at = np.unique(np.concatenate([np.concatenate(x) for x in zip(*held)]), return_inverse=True)
        x, y = np.split(at, 2)
        root = np.arange(len(names))
        forest(root, x, y)
        far = np.flatnonzero(root != np.arange(len(root)))
        for start in range(0, len(far), 1 << 16):
            part = far[start : start + (1 << 16)]
            yield pa.record_batch({"a": pa.array(names[root[part]]), "b": pa.array(names[part])})


def _joined(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a before b, that connect what all of them connect: those of a task become stars."""
    ensure_shipped(edges.sparkSession)
    held = cut(edges)
    return cut(held.repartition(-(-held.count() // TREE_EDGES) or 1).mapInArrow(_trees, "a bigint, b bigint"))


def components(genomes: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """(label, genome, component): connected components of the edges of at least ``least``; the smallest genome names one.

    Edges are first joined to trees task by task. Each round points a genome to the smallest among itself and its neighbours and rewrites the edges over the genomes
    pointed to, so the graph shrinks until no edge is left; every other later round orders by a hash of the id, which
    keeps chains short. Genomes without edges take no part.
    """
    strong = edges.filter((F.col("ani") >= least) & (F.col("query") != F.col("refer")))
    left = _joined(strong.select(F.least("query", "refer").alias("a"), F.greatest("query", "refer").alias("b")))
    found: DataFrame | None = None
    turn = 0
    while left.limit(1).count():
        mixed = F.xxhash64("b", F.lit(turn)) if turn % 2 and turn > 1 else F.lit(0)
        own = F.xxhash64("a", F.lit(turn)) if turn % 2 and turn > 1 else F.lit(0)
        both = left.select("a", "b").union(left.select("b", "a"))
        near = F.min(F.struct(mixed.cast("long").alias("o"), F.col("b").alias("id")))
        best = both.groupBy("a").agg(F.least(near, F.min(F.struct(own.cast("long").alias("o"), F.col("a").alias("id")))).alias("best"))
        step = cut(best.select(F.col("a").alias("genome"), F.col("best.id").alias("to")))
        if found is None:
            found = step
        else:
            found = found.join(step.withColumnRenamed("genome", "_g").withColumnRenamed("to", "_to"), F.col("to") == F.col("_g"), "left").select("genome", F.coalesce("_to", "to").alias("to"))
        ends = {x: step.select(F.col("genome").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab"}
        moved = left.join(ends["a"], "a").join(ends["b"], "b").filter("to_a <> to_b")
        left = _joined(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        turn += 1
    if found is None:
        return genomes.select("label", "genome", F.col("genome").alias("component"))
    found = cut(found)
    smallest = found.groupBy("to").agg(F.min("genome").alias("component"))
    named = found.join(smallest, "to").select("genome", "component")
    return genomes.select("label", "genome").join(named, "genome", "left").select("label", "genome", F.coalesce("component", "genome").alias("component"))


def representatives(members: DataFrame) -> DataFrame:
    """(label, component, genome): the reference genome of a component, else the one with the largest N50, else none."""
    order = F.struct(F.col("is_ref").cast("int"), "n50", -F.col("genome"))
    best = members.filter(F.col("n50").isNotNull() | F.col("is_ref")).groupBy("label", "component").agg(F.max_by("genome", order).alias("genome"))
    return best


def fallback(selected: DataFrame, genomes: DataFrame) -> DataFrame:
    """Labels without a selection get their reference genome, else the one with the largest N50."""
    order = F.struct(F.col("is_ref").cast("int"), "n50", -F.col("genome"))
    best = genomes.groupBy("label").agg(F.max_by("genome", order).alias("genome"))
    return selected.select("label", "genome").union(best.join(selected.select("label").distinct(), "label", "left_anti").select("label", "genome"))


def top_by_n50(genomes: DataFrame, most: int) -> DataFrame:
    """The ``most`` genomes of each label with the largest N50."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n50"), "genome"))
    return genomes.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r")


def clique_selection(reps: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """(label, genome): per label the largest clique of representatives whose pairs reach ``least``, of those with the
    reference genome if there is one. A clique lies in one connected component, so a task holds one component of a label."""
    weak = edges.filter(F.col("ani") >= least)
    held = reps.select("label", "genome", "is_ref")
    left = weak.join(held.select("label", F.col("genome").alias("query")), ["label", "query"], "left_semi")
    pairs = cut(left.join(held.select("label", F.col("genome").alias("refer")), ["label", "refer"], "left_semi").select("label", "query", "refer", "ani"))
    member = components(held, pairs, least).select("label", "genome", "component").join(held, ["label", "genome"])
    linked = pairs.join(member.select(F.col("genome").alias("query"), "component"), "query")
    rows = member.select("label", "component", "genome", F.lit(None).cast("bigint").alias("other"), "is_ref")
    rows = rows.union(linked.select("label", "component", F.col("query"), F.col("refer"), F.lit(False)))

    def select(frame: pd.DataFrame) -> pd.DataFrame:
        alone = frame[frame.other.isna()]
        links = [(int(a), int(b)) for a, b in frame[frame.other.notna()][["genome", "other"]].itertuples(index=False)]
        refs = set(alone[alone.is_ref].genome.astype(int))
        best = best_cliques(links, list(alone.genome.astype(int)), refs)
        return pd.DataFrame({"label": frame.label.iloc[0], "with_ref": [False, True][: len(best)], "clique": best})

    ensure_shipped(rows.sparkSession)
    found = rows.groupBy("label", "component").applyInPandas(select, "label int, with_ref boolean, clique array<bigint>")
    order = F.struct(F.col("with_ref").cast("int"), F.size("clique"), F.transform("clique", lambda x: -x))
    return found.groupBy("label").agg(F.max_by("clique", order).alias("clique")).select("label", F.explode("clique").alias("genome"))


def linkage_clusters(dist: np.ndarray, height: float, method: str = "complete") -> np.ndarray:
    """Agglomerative clusters of a distance matrix cut at a height; numbered by first member.

    A chain goes from a cluster to its nearest, on to that one's nearest, until two are nearest to each other; these are
    merged and the chain goes on, so that all merges take time quadratic in the number of members.
    """
    n = len(dist)
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, root, live = np.ones(n), np.arange(n), np.ones(n, bool)
    chain: list[int] = []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.argmax(live)))
        while True:
            i = chain[-1]
            row = np.where(live, d[i], np.inf)
            j = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[j]:
                j = chain[-2]
                break
            chain.append(j)
        del chain[-2:]
        i, j, gap = min(i, j), max(i, j), d[i, j]
        merged = {"single": np.minimum(d[i], d[j]), "complete": np.maximum(d[i], d[j]), "average": (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])}[method]
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        live[j] = False
        size[i] += size[j]
        if gap <= height:
            root[root == root[j]] = root[i]
    first = {}
    return np.unique([first.setdefault(r, k) for k, r in enumerate(root)], return_inverse=True)[1]


def complete_clusters(n: int, left: np.ndarray, right: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Complete linkage of n members from the pairs within the height alone; numbered by first member.

    The chain of ``linkage_clusters`` over lists of neighbours: two clusters are neighbours while all pairs across are
    within the height, so a merged one keeps what both were near to, at the larger distance. Room and time go with the pairs.
    """
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, d in zip(left.tolist(), right.tolist(), gap.tolist()):
        near[i][j] = near[j][i] = d
    root = np.arange(n)
    chain: list[int] = []
    for start in range(n):
        while chain or near[start]:
            if not chain:
                chain.append(start)
            i = chain[-1]
            if not near[i]:  # as large as it gets
                chain.pop()
                continue
            j = min(near[i], key=lambda x: (near[i][x], x))
            if len(chain) < 2 or near[i].get(chain[-2], np.inf) > near[i][j]:
                chain.append(j)
                continue
            j = chain[-2]
            del chain[-2:]
            i, j = min(i, j), max(i, j)
            small, large = sorted((near[i], near[j]), key=len)
            both = {k: max(d, large[k]) for k, d in small.items() if k in large}
            for x in (i, j):
                for k in near[x]:
                    near[k].pop(x, None)
            near[i], near[j] = both, {}
            for k, d in both.items():
                near[k][i] = d
            root[j] = i
    for k in range(n):  # a cluster's root has the smallest number, so roots of smaller members are final
        root[k] = root[root[k]]
    first = {}
    return np.unique([first.setdefault(r, k) for k, r in enumerate(root)], return_inverse=True)[1]


#: Pairs within the cutoff of a component that one task links; larger components are first merged by all tasks, round by round.
LINKAGE_PAIRS = 500_000
#: Pairs of which a task tells the nearest at a time.
NEAREST_PAIRS = 1 << 19


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (query, refer, ani) -> (genome, ani, low, high): of each genome the pair of the largest value, of equal ones the first."""
    best: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    held: list[list[np.ndarray]] = []

    def told() -> None:
        q, r, ani = (np.concatenate(x) for x in zip(*held))
        low, high = np.minimum(q, r), np.maximum(q, r)
        every = [np.concatenate([b, *x]) for b, x in zip(best, ((q, r), (ani, ani), (low, low), (high, high)))]
        order = np.lexsort((every[3], every[2], -every[1], every[0]))
        first = order[np.r_[True, np.diff(every[0][order]) != 0]]
        best[:] = [x[first] for x in every]
        held.clear()

    for batch in batches:
        if batch.num_rows:
            held.append([np.asarray(batch.column(k)) for k in range(3)])
        if sum(len(x[0]) for x in held) >= NEAREST_PAIRS:
            told()
    if held:
        told()
    for start in range(0, len(best[0]), 1 << 16):
        yield pa.record_batch({k: pa.array(x[start : start + (1 << 16)]) for k, x in zip(("genome", "ani", "low", "high"), best)})


def _largest(edges: DataFrame, member: DataFrame) -> int:
    """Pairs of the component (label, genome, component) that has most."""
    sizes = edges.groupBy("label", F.col("query").alias("genome")).count().join(member, ["label", "genome"])
    return sizes.groupBy("label", "component").agg(F.sum("count").alias("n")).agg(F.max("n")).first()[0] or 0


def _merged(edges: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """A round of complete linkage over pairs (label, query, refer, ani), each unordered pair once: all genomes that are each other's nearest are one.

    Returns which genomes become which (genome, to), and the pairs of what is then: one is near to another while all pairs
    across are, at the least value. None if no two are each other's nearest, which numbers rule out.
    """
    ensure_shipped(edges.sparkSession)
    near = edges.select("query", "refer", "ani").mapInArrow(_nearest, "genome bigint, ani double, low bigint, high bigint")
    best = near.groupBy("genome").agg(F.max(F.struct("ani", -F.col("low"), -F.col("high"))).alias("b"))
    both = best.groupBy((-F.col("b.col2")).alias("low"), (-F.col("b.col3")).alias("high")).count().filter("count = 2")
    step = cut(both.select(F.explode(F.array("low", "high")).alias("genome"), F.col("low").alias("to")))
    if not step.limit(1).count():
        return None
    held = beside_pairs(step)
    side = lambda x: held.select(F.col("genome").alias(x), F.col("to").alias(f"{x}_to"))
    moved = edges.join(side("query"), "query", "left").join(side("refer"), "refer", "left")
    part = lambda x: F.when(F.col(f"{x}_to").isNull(), 1).otherwise(2)
    moved = moved.select("label", F.coalesce("query_to", "query").alias("q"), F.coalesce("refer_to", "refer").alias("r"), "ani", (part("query") * part("refer")).alias("parts")).filter("q <> r")
    joined = moved.filter("parts > 1").groupBy("label", F.least("q", "r").alias("query"), F.greatest("q", "r").alias("refer"), "parts").agg(F.min("ani").alias("ani"), F.count(F.lit(1)).alias("n"))
    left = moved.filter("parts = 1").select("label", F.col("q").alias("query"), F.col("r").alias("refer"), "ani")
    return step, cut(left.union(joined.filter("n = parts").select("label", "query", "refer", "ani")))


def hierarchical(genomes: DataFrame, edges: DataFrame, cutoff: float, method: str = "complete", connected: DataFrame | None = None) -> DataFrame:
    """(label, genome, cluster): linkage clusters cut at distance 100 - cutoff, each named by its smallest genome; pairs without a similarity are 100 apart.

    Complete linkage joins only genomes that are all within the cutoff, so its clusters lie inside the components of such
    pairs, and a task holds one component's pairs within the cutoff, up to LINKAGE_PAIRS: larger components are first merged by
    all tasks until no more pairs are left. That needs each unordered pair once; of equal values either may be merged first. Single linkage is ``components`` at the cutoff, at any size. Average
    linkage may join components, and a task holds a label's matrix. ``connected`` (label, genome, component) are the
    components at the cutoff, if they are known from fewer pairs.
    """
    if method == "single":
        return (components(genomes, edges, cutoff) if connected is None else connected).withColumnRenamed("component", "cluster")
    if method == "complete":  # clusters that hold a pair beyond the cutoff stay apart, however far it is
        edges = edges.filter(F.col("ani") >= cutoff)
        if connected is None:
            edges = cut(edges)
            connected = components(genomes, edges, cutoff)
        member = connected
    else:
        member = genomes.withColumn("component", F.lit(0).cast("bigint"))
    member = cut(member.select("label", "genome", "component"))
    alone = member.groupBy("label", "component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1" if method == "complete" else "n > 0")
    member = member.join(alone.select("label", "component"), ["label", "component"], "left_semi")
    whole, found = member, None
    if method == "complete":
        member = cut(member)
        while _largest(edges, member) > LINKAGE_PAIRS and (merged := _merged(edges)):
            step, edges = merged
            if found is None:
                found = member.select("label", "genome", F.col("genome").alias("to"))
            named = step.filter("genome <> to").select(F.col("genome").alias("_g"), F.col("to").alias("_to"))
            found = cut(found.join(beside_pairs(named), F.col("to") == F.col("_g"), "left").select("label", "genome", F.coalesce("_to", "to").alias("to")))
        if found is not None:  # what was merged is named by its smallest genome
            whole, member = member, cut(member.join(found.filter("genome = to").select("label", "genome"), ["label", "genome"], "left_semi"))
    held = beside_pairs(member)
    side = lambda name: held.select("label", F.col("genome").alias(name), F.col("component").alias(f"{name}_c"))
    inside = edges.join(side("query"), ["label", "query"]).join(side("refer"), ["label", "refer"]).filter("query_c = refer_c")
    rows = member.select("label", "component", "genome", F.lit(None).cast("bigint").alias("other"), F.lit(None).cast("double").alias("ani"))
    rows = rows.union(inside.select("label", "query_c", "query", "refer", "ani"))

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(frame[frame.other.isna()].genome.to_numpy(np.int64))
        pairs = frame[frame.other.notna()]
        a, b = np.searchsorted(names, pairs.genome.to_numpy(np.int64)), np.searchsorted(names, pairs.other.to_numpy(np.int64))
        gap = 100 - pairs.ani.to_numpy(float)
        if method == "complete":
            number = complete_clusters(len(names), a, b, gap)
        else:
            dist = np.full((len(names), len(names)), 100.0)
            dist[a, b] = dist[b, a] = gap
            number = linkage_clusters(dist, 100 - cutoff, method)
        return pd.DataFrame({"label": frame.label.iloc[0], "genome": names, "cluster": names[np.unique(number, return_index=True)[1]][number]})

    ensure_shipped(rows.sparkSession)
    linked = rows.groupBy("label", "component").applyInPandas(cluster, "label int, genome bigint, cluster bigint")
    if found is not None:
        linked = found.join(linked.withColumnRenamed("genome", "to"), ["label", "to"]).select("label", "genome", "cluster")
    rest = genomes.select("label", "genome", F.col("genome").alias("cluster")).join(whole, ["label", "genome"], "left_anti")
    return linked.union(rest)


def medoids(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, cluster, genome): of one or two members the first, else the one with the least mean distance to the others; pairs without a similarity are 100 apart."""
    members = cut(members.select("label", "genome", "cluster"))
    held = beside_pairs(members)
    own = held.select("label", F.col("genome").alias("query"), "cluster")
    other = held.select("label", F.col("genome").alias("refer"), F.col("cluster").alias("_c"))
    inside = _both_ways(edges.join(own, ["label", "query"]).join(other, ["label", "refer"]).filter("cluster = _c").select("label", "query", "refer", "ani"))
    inside = inside.join(own, ["label", "query"])
    known = inside.groupBy("label", "cluster", "query").agg(F.sum(100 - F.col("ani")).alias("_sum"), F.count(F.lit(1)).alias("_k"))
    sizes = members.groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("_n"), F.min("genome").alias("_first"))
    others = F.col("_n") - 1
    mean = known.join(sizes, ["label", "cluster"]).withColumn("_d", F.round((F.col("_sum") + 100 * (others - F.col("_k"))) / others, 6))
    best = mean.groupBy("label", "cluster").agg(F.min_by("query", F.struct("_d", "query")).alias("_best"))
    return sizes.join(best, ["label", "cluster"], "left").select("label", "cluster", F.when(F.col("_n") <= 2, F.col("_first")).otherwise(F.col("_best")).alias("genome"))


def reassign(genomes: DataFrame, reps: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, genome, rep): each genome with the representative of its label nearest to it; a representative with itself."""
    reps = cut(reps.select("label", "genome"))
    held = beside_pairs(reps)
    near = _both_ways(edges).join(held.select("label", F.col("genome").alias("refer")), ["label", "refer"]).withColumnRenamed("query", "genome")
    near = near.join(held, ["label", "genome"], "left_anti").groupBy("label", "genome").agg(F.max_by("refer", F.struct("ani", -F.col("refer"))).alias("rep"))
    return near.select("label", "genome", "rep").union(reps.select("label", "genome", F.col("genome").alias("rep")))


def cluster_lists(members: DataFrame) -> DataFrame:
    """(label, cluster, genomes, size): each cluster's genomes in order, large clusters first."""
    listed = members.groupBy("label", "cluster").agg(F.array_sort(F.collect_list("genome")).alias("genomes"))
    return listed.withColumn("size", F.size("genomes")).orderBy("label", F.desc("size"), "cluster")


def with_reference(labels: DataFrame, genomes: DataFrame) -> DataFrame:
    """(label, reference) of each label: its reference genome, the smallest if there are several, or null."""
    refs = genomes.filter("is_ref").groupBy("label").agg(F.min("genome").alias("reference"))
    return labels.select("label").distinct().join(refs, "label", "left")


def linkage_conditions(members: DataFrame, edges: DataFrame, cutoff: float) -> DataFrame:
    """(label, genomes, compact, mergeable): whether all pairs inside clusters reach the cutoff, and how many pairs of
    clusters could still be joined because all pairs across reach it; what complete linkage must leave is true and 0."""
    strong, members = edges.filter(F.col("ani") >= cutoff), cut(members.select("label", "genome", "cluster"))
    held = beside_pairs(members)
    side = lambda name: held.select("label", F.col("genome").alias(name), F.col("cluster").alias(f"{name}_c"))
    known = strong.join(side("query"), ["label", "query"]).join(side("refer"), ["label", "refer"])
    between = cut(known.groupBy("label", F.least("query_c", "refer_c").alias("a"), F.greatest("query_c", "refer_c").alias("b")).agg(F.count(F.lit(1)).alias("n")))
    sizes = members.groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("size"))
    inside = sizes.join(between.filter("a = b").select("label", F.col("a").alias("cluster"), "n"), ["label", "cluster"], "left")
    told = inside.groupBy("label").agg(F.sum("size").alias("genomes"), F.every(F.coalesce("n", F.lit(0)) * 2 == F.col("size") * (F.col("size") - 1)).alias("compact"))
    of = lambda x: sizes.select("label", F.col("cluster").alias(x), F.col("size").alias(f"size_{x}"))
    open_ = between.filter("a <> b").join(of("a"), ["label", "a"]).join(of("b"), ["label", "b"]).filter("n = size_a * size_b")
    return told.join(open_.groupBy("label").agg(F.count(F.lit(1)).alias("mergeable")), "label", "left").fillna(0, ["mergeable"])


def longest_per_group(rows: DataFrame, group: str, name: str, length: str) -> DataFrame:
    """(group, name, length) of the row with the greatest length of each group, of equals the smallest name."""
    return rows.groupBy(group).agg(F.max_by(name, F.struct(length, -F.col(name))).alias(name), F.max(length).alias(length))


def expand_clusters(reps: DataFrame, members: DataFrame) -> DataFrame:
    """All members of the clusters of the chosen representatives."""
    chosen = members.join(reps.select("label", "genome"), ["label", "genome"], "left_semi").select("label", "cluster").distinct()
    return members.join(chosen, ["label", "cluster"])


def filter_matrix(long: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows and columns of a long-form matrix (i, j, dist) whose names (genome) are kept."""
    held = beside_pairs(keep.select("genome").distinct())
    out = long.join(held.withColumnRenamed("genome", "i"), "i", "left_semi")
    return out.join(held.withColumnRenamed("genome", "j"), "j", "left_semi").select("i", "j", "dist")
