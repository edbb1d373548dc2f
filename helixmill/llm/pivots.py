"""Embedding near-duplicates through a pivot-permutation index.

Each vector is described by the order of its nearest reference points. Inverted lists are kept per three pivots, so that
a list is short however long the lists of single pivots get; two vectors of a label are candidates if they share three
pivots that rank high for both (the ranks of the three add up to RANKS at most), and are verified by cosine in double
precision, block by block. Only link counts and spanning links leave a task. A pair is counted in one of its lists.

Vectors of one description that lie within half the threshold's angle of a common one, the leader, are a cell: all of
them link with each other, whatever their number. Lists hold cells. Two cells whose leaders' angle and radii decide it
link as a whole or not at all; else the members of one are put to the leader and radius of the other, and only those
that this leaves open meet its members. So a dense group costs its size and not its square.

Pivots come from a documented sample: of the 1,024 distinct vectors with the smallest hashes, 128 that lie far apart, so
that a dense group supplies one pivot and not many whose order is noise. Every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.shipping import ensure_shipped

from .common import join_checked, materialize, union_all
from .components import connected_components
from .simhash import local_roots

SAMPLE, PIVOTS, NEAREST, SHARED = 1024, 128, 6, 3
#: Ranks count from 0; of the 20 threes of six pivots those up to this sum are listed.
RANKS = 9
BLOCK = 512
#: Rounds in which the vectors of a description that are in no cell yet get another leader.
LEADERS = 3
#: Angles this near to a bound are decided by the vectors themselves.
CLOSE = 1e-7
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27))


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x, np.float64) for x in column.to_numpy(zero_copy_only=False)]


def far_apart(rows: list[np.ndarray], n: int, alike: float = 0.8, least: int = 16) -> np.ndarray:
    """Up to n of the vectors, each the one least similar to those before, zero-padded to one length.

    Beyond the first ``least`` none is ``alike`` to another: two pivots inside one dense group would put the group's
    vectors in an order that is noise.
    """
    width = max(map(len, rows), default=0)
    if not rows:
        return np.zeros((0, 0))
    x = np.stack([np.pad(r, (0, width - len(r))) for r in rows])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(n, len(x)) and (len(chosen) < least or nearest.min() < alike):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen]


def threes(near: int) -> np.ndarray:
    """The places of the pivots that lists are kept for, three each, in a description of ``near`` pivots."""
    chosen = [c for c in combinations(range(near), min(SHARED, near)) if sum(c) <= RANKS]
    return np.array(chosen, np.int64).reshape(-1, min(SHARED, near))


def list_keys(group: np.ndarray, order: np.ndarray, near: int) -> np.ndarray:
    """The keys of each description's lists; ``order`` holds a pivot per byte, the nearest in the lowest."""
    pivots = (order[:, None] >> np.uint64(8) * np.arange(near, dtype=np.uint64)) & np.uint64(255)
    out = []
    for places in threes(near):
        key = group
        for pivot in np.sort(pivots[:, places], axis=1).T:
            key = _mixed(key * np.uint64(257) + pivot + np.uint64(1))
        out.append(key)
    return np.stack(out, axis=1) if out else np.zeros((len(order), 0), np.uint64)


def _describe(pivots: np.ndarray):
    """(cid, group, embedding) -> (cid, group, order): the nearest pivots in order, one per byte."""
    width = pivots.shape[1] if len(pivots) else 0
    unit = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300)
    near = min(NEAREST, len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _vectors(batch.column(2))
            x = np.zeros((len(rows), width))
            for i, row in enumerate(rows):  # vectors of another length are compared with pivots as far as both go
                x[i, : min(len(row), width)] = row[:width]
            top = np.argsort(-(x @ unit.T), axis=1, kind="stable")[:, :near].astype(np.uint64)
            order = (top << np.uint64(8) * np.arange(near, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if near else np.zeros(len(rows), np.uint64)
            yield pa.record_batch({"cid": batch.column(0), "group": batch.column(1), "order": pa.array(order.view(np.int64))})

    return run, near


def _units(column: pa.Array) -> np.ndarray:
    """Unit vectors as rows, shorter ones padded."""
    rows = _vectors(column)
    wide = max(map(len, rows), default=0)
    x = np.stack([np.pad(v, (0, wide - len(v))) for v in rows]) if rows else np.zeros((0, wide))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (..., embedding, other) of vectors of one length -> the rows without these and with their cosine."""
    for batch in batches:
        a, b = (_vectors(batch.column(n)) for n in ("embedding", "other"))
        cosine = np.array([x @ y / np.sqrt((x @ x) * (y @ y)) for x, y in zip(a, b)], float)
        rest = [n for n in batch.schema.names if n not in ("embedding", "other")]
        yield pa.record_batch({**{n: batch.column(n) for n in rest}, "cosine": pa.array(cosine)})


def _verify(threshold: float, near: int):
    """Rows by list and pair of blocks (key, first, second, block, cell, group, order, weight, radius, embedding) ->
    (cell, peer, links) of links as a whole, and (cell, peer, null) of pairs of cells that their members must decide."""
    angle = float(np.arccos(threshold))

    def linked(t: dict[str, np.ndarray], x: np.ndarray) -> pa.RecordBatch | None:
        similar = x @ x.T
        near_by = similar >= np.cos(min(angle + 2 * t["radius"].max() + CLOSE, np.pi))
        np.fill_diagonal(near_by, False)
        near_by &= t["group"][:, None] == t["group"][None, :]
        if t["first"][0] != t["second"][0]:
            near_by &= t["block"][:, None] != t["block"][None, :]
        a, b = np.nonzero(near_by)
        if not len(a):
            return None
        keys = list_keys(t["group"].view(np.uint64), t["order"].view(np.uint64), near)
        mine = np.zeros(len(a), bool)
        for start in range(0, len(a), 1 << 14):
            ka, kb = keys[a[start : start + (1 << 14)]], keys[b[start : start + (1 << 14)]]
            both = np.where((ka[:, :, None] == kb[:, None, :]).any(axis=2), ka, np.uint64(2**64 - 1))
            mine[start : start + (1 << 14)] = both.min(axis=1) == t["key"][:1].view(np.uint64)
        a, b = a[mine], b[mine]  # each pair in one list only
        reach = t["radius"][a] + t["radius"][b]
        cosine = similar[a, b]
        apart = np.arccos(np.clip(cosine, -1, 1))
        whole = np.where(reach == 0, cosine >= threshold, apart + reach <= angle - CLOSE)
        open_ = ~whole & (reach > 0) & (apart - reach <= angle + CLOSE) & (t["cell"][a] < t["cell"][b])
        wa, wb = a[whole], b[whole]
        links = np.bincount(wa, weights=t["weight"][wb], minlength=len(x)).astype(np.int64)
        root, at = local_roots(len(x), wa, wb), np.unique(wa)
        cell = np.concatenate([t["cell"][at], t["cell"][a[open_]]])
        peer = np.concatenate([t["cell"][root[at]], t["cell"][b[open_]]])
        told = pa.array(np.concatenate([links[at], np.zeros(open_.sum(), np.int64)]), mask=np.r_[np.zeros(len(at), bool), np.ones(open_.sum(), bool)])
        return pa.record_batch({"cell": pa.array(cell), "peer": pa.array(peer), "links": told})

    names = ("key", "first", "second", "block", "cell", "group", "order", "weight", "radius")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def groups(table: pa.Table, final: bool):
            t = {n: table.column(n).combine_chunks().to_numpy() for n in names}
            new = np.flatnonzero(np.r_[True, (t["key"][1:] != t["key"][:-1]) | (t["first"][1:] != t["first"][:-1]) | (t["second"][1:] != t["second"][:-1])])
            ends = np.r_[new[1:], len(t["key"])]
            last = len(new) if final else len(new) - 1
            vectors = table.column("embedding").combine_chunks()
            for s, e in zip(new[:last], ends[:last]):
                if e - s > 1:
                    made = linked({k: v[s:e] for k, v in t.items()}, _units(vectors[int(s) : int(e)]))
                    if made is not None:
                        yield made
            rest.append(None if final or not len(new) else table.slice(int(new[-1])))

        rest: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            yield from groups(held, False)
            held = rest.pop()
        if held is not None and held.num_rows:
            yield from groups(held, True)

    return run


def _cells(described: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(cid, cell, cosine): each class's cell, named by its leader, and its cosine with the leader."""
    half = float(np.cos(np.arccos(threshold) / 2 - CLOSE))
    left, found = described, []
    for _ in range(LEADERS):
        leaders = left.groupBy("group", "order").agg(F.min("cid").alias("cell"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("group", "order", "cell")
        leaders = materialize(leaders, "leaders")
        if not leaders.limit(1).count():
            break
        named = join_checked(left, leaders, ["group", "order"]).select("cid", "cell")
        of = classes.select("cid", "embedding")
        both = named.join(of, "cid").join(of.select(F.col("cid").alias("cell"), F.col("embedding").alias("other")), "cell")
        told = materialize(both.select("cid", "cell", "embedding", "other").mapInArrow(_cosines, "cid long, cell long, cosine double"), "cosines")
        inside = told.filter((F.col("cosine") >= half) | (F.col("cid") == F.col("cell")))
        found.append(inside)
        left = materialize(left.join(inside.select("cid"), "cid", "left_anti"), "left")
    return union_all([left.select("cid", F.col("cid").alias("cell"), F.lit(1.0).alias("cosine")), *found])


def link_vectors(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links of the classes (cid, group, embedding, copies): (cid, links) counted, and (a, b) that connect the same classes."""
    spark = classes.sparkSession
    ensure_shipped(spark)
    sample = classes.orderBy(F.xxhash64("embedding"), "cid").limit(SAMPLE).select("embedding").collect()
    run, near = _describe(far_apart([np.asarray(r[0], np.float64) for r in sample], PIVOTS))
    described = materialize(classes.select("cid", "group", "embedding").mapInArrow(run, "cid long, group long, order long"), "described")
    member = materialize(_cells(described, classes, threshold), "cells")
    angle = F.acos(F.least(F.greatest("cosine", F.lit(-1.0)), F.lit(1.0)))
    weighed = member.join(classes.select("cid", "copies"), "cid")
    own = weighed.groupBy("cell").agg(F.sum("copies").alias("weight"), F.max(F.when(F.col("cid") == F.col("cell"), 0.0).otherwise(angle)).alias("radius"))
    cells = materialize(own.join(described.withColumnRenamed("cid", "cell"), "cell").join(classes.select(F.col("cid").alias("cell"), "embedding"), "cell"), "weighed")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, group, order = (np.asarray(batch.column(i)) for i in range(3))
            for key in list_keys(group.view(np.uint64), order.view(np.uint64), near).T:
                yield pa.record_batch({"cell": pa.array(cell), "key": pa.array(np.ascontiguousarray(key).view(np.int64))})

    keyed = materialize(cells.select("cell", "group", "order").mapInArrow(listed, "cell long, key long"), "pivot_lists")
    lists = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "lists")
    rows = join_checked(keyed, lists, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cell"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = rows.select("cell", "key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = pairs.join(cells, "cell").repartition(tasks, "key", "first", "second").sortWithinPartitions("key", "first", "second")
    found = materialize(full.mapInArrow(_verify(threshold, near), "cell long, peer long, links long"), "vector_links")
    whole = found.filter("links is not null")
    inside = weighed.join(own.select("cell", "weight"), "cell").join(whole.groupBy("cell").agg(F.sum("links").alias("links")), "cell", "left")
    counts = inside.select("cid", (F.col("weight") - F.col("copies") + F.coalesce("links", F.lit(0))).alias("links"))
    edges = whole.select(F.col("cell").alias("a"), F.col("peer").alias("b")).union(member.select("cid", "cell"))
    open_ = found.filter("links is null").select("cell", "peer")
    if open_.limit(1).count():
        more, links = _decided(open_.union(open_.select("peer", "cell")), weighed, cells, classes, threshold)
        counts, edges = counts.union(more), edges.union(links)
    return counts, edges


def _decided(open_: DataFrame, weighed: DataFrame, cells: DataFrame, classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links of the members of each cell with another cell (cell, peer), both ways round: counted, and (a, b)."""
    angle = float(np.arccos(threshold))
    of = classes.select("cid", "embedding")
    asked = open_.join(weighed.select("cid", "cell"), "cell").join(of, "cid")
    asked = asked.join(cells.select(F.col("cell").alias("peer"), "weight", "radius", F.col("embedding").alias("other")), "peer")
    told = materialize(asked.select("cid", "peer", "weight", "radius", "embedding", "other").mapInArrow(_cosines, "cid long, peer long, weight long, radius double, cosine double"), "asked")
    apart = F.acos(F.least(F.greatest("cosine", F.lit(-1.0)), F.lit(1.0)))
    whole = told.filter(apart + F.col("radius") <= angle - CLOSE)
    unsure = told.filter((apart + F.col("radius") > angle - CLOSE) & (apart - F.col("radius") <= angle + CLOSE)).select("cid", "peer")
    both = unsure.join(weighed.select(F.col("cid").alias("to"), F.col("cell").alias("peer"), "copies"), "peer").join(of, "cid")
    both = both.join(of.select(F.col("cid").alias("to"), F.col("embedding").alias("other")), "to")
    exact = materialize(both.select("cid", "to", "copies", "embedding", "other").mapInArrow(_cosines, "cid long, to long, copies long, cosine double"), "exact")
    exact = exact.filter(F.col("cosine") >= threshold)
    counts = whole.select("cid", F.col("weight").alias("links")).union(exact.select("cid", F.col("copies").alias("links")))
    return counts, whole.select(F.col("cid").alias("a"), F.col("peer").alias("b")).union(exact.select("cid", "to"))


def near_duplicates(embeddings: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Defined cases: null labels, and vectors that are null, zero or hold a null or non-finite component, link with
    nothing; vectors of different lengths don't link; equal vectors link with each other; a null vec_id never names
    a component that has another; an empty input gives an empty result. Other columns are ignored.
    """
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(broken, F.lit(True)) & F.exists("embedding", lambda x: x != 0)
    rows = embeddings.select("vec_id", "label", "embedding").withColumn("usable", F.coalesce(usable, F.lit(False)))
    good = rows.filter("usable")
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("group", F.xxhash64("label", F.size("embedding"))).withColumn("cid", F.monotonically_increasing_id()), "classes")
    links, edges = link_vectors(classes.select("cid", "group", "embedding", "copies"), threshold)
    roots = connected_components(edges.select("a", "b"))
    member = roots.select(F.col("node").alias("cid"), "root")
    least = classes.join(member, "cid").groupBy("root").agg(F.min("first").alias("least"))
    counts = links.groupBy("cid").agg(F.sum("links").alias("links"))
    told = (
        classes.join(counts, "cid", "left").join(member, "cid", "left").join(least, "root", "left")
        .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    )
    found = good.join(told, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
