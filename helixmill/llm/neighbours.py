"""Approximate nearest neighbours over robust-pruned directed graphs.

Equal vectors are one point. Points are dealt to shards by a hash; a shard's graph is built in one task, in numpy, many
points at a time: greedy searches over the graph so far propose neighbours, and pruning goes through these from near to
far and drops what is ALPHA times nearer to a neighbour already taken than to the point itself, so that edges point in
different directions and a few long ones stay. Edges are added both ways and pruned where a point gets too many. Points
that no path from the shard's centre reaches are entries of their own. Every shard's graph is written as one row; each
block of queries then meets each shard, runs a beam search over its graph, and the nearest of all shards are kept.
Distances are Euclidean, in double precision, on the vectors as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.shipping import ensure_shipped

from .common import lean, materialize, settled

#: Edges of a point at most, results that a search holds while the graph is built and when it is queried.
DEGREE, PROPOSED, BEAM = 32, 64, 128
#: How much nearer to a chosen neighbour than to the point itself a candidate must be to go.
ALPHA = 1.2
#: Points that a search expands at once, points or queries that are searched together.
EXPANDED, TOGETHER = 4, 256
#: Points of a shard, and bytes of its vectors, at most (on average: hashes deal them).
SHARD, SHARD_BYTES = 8192, 16 << 20
#: Queries of a block.
BLOCK = 512
TOP = 10


def squared(x: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of each row of q from the points that its row of ``at`` names."""
    apart = x[at] - q[:, None, :]
    return np.einsum("rkd,rkd->rk", apart, apart)


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the nearest points found for each query, nearest first; -1 and inf where fewer were.

    All queries take their steps together: each expands the nearest of its held points that it hasn't expanded yet.
    """
    n, rows = len(q), np.arange(len(q))
    seen = np.zeros((n, len(x)), bool)
    ids, dist, done = np.full((n, beam), -1), np.full((n, beam), np.inf), np.zeros((n, beam), bool)
    live = rows
    fresh = np.broadcast_to(entries, (n, len(entries)))
    while len(live):
        if fresh.shape[1]:
            seen[live[:, None], fresh] = True
            far = squared(x, fresh, q[live])
            far[fresh < 0] = np.inf
            every = np.concatenate([dist[live], far], axis=1)
            order = np.argsort(every, axis=1, kind="stable")[:, :beam]
            dist[live] = np.take_along_axis(every, order, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(np.isinf(far), -1, fresh)], axis=1), order, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(fresh.shape, bool)], axis=1), order, 1)
        open_ = np.where(done | (ids < 0), np.inf, dist)[live]
        order = np.argsort(open_, axis=1, kind="stable")[:, :EXPANDED]
        some = np.isfinite(np.take_along_axis(open_, order, 1))
        left = some[:, 0]
        live, order, some = live[left], order[left], some[left]
        if not len(live):
            break
        done[live[:, None], order] |= some
        near = graph[np.where(some, ids[live[:, None], order], -1)].reshape(len(live), -1)  # the graph's last row has no edges
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[(near >= 0) & seen[live[:, None], near]] = -1
        near = np.sort(near, axis=1)[:, ::-1]
        fresh = near[:, : int((near >= 0).sum(axis=1).max())]
    return ids, dist


def robust_prune(x: np.ndarray, ids: np.ndarray, dist: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each row of candidates (-1 for none) and their squared distances: up to ``degree`` diverse ones, -1 for the rest."""
    order = np.argsort(np.where(ids < 0, np.inf, dist), axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    v = x[ids]
    sq = np.einsum("rkd,rkd->rk", v, v)
    between = sq[:, :, None] + sq[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
    alive = (ids >= 0) & np.isfinite(dist)
    out = np.full((len(ids), degree), -1)
    rows = np.arange(len(ids))
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, k] = ids[rows, first][some]
        alive &= ~(some[:, None] & (alpha * alpha * between[rows, first] <= dist))
        alive[rows, first] = False
    return out


def _add_back(x: np.ndarray, graph: np.ndarray, source: np.ndarray, target: np.ndarray, alpha: float) -> None:
    """Add the edges target -> source; points that get more than fit are pruned."""
    order = np.lexsort((source, target))
    source, target = source[order], target[order]
    points, first, new = np.unique(target, return_index=True, return_counts=True)
    have = (graph[points] >= 0).sum(axis=1)
    degree = graph.shape[1]
    place = np.arange(len(target)) - np.repeat(first, new) + np.repeat(have, new)
    fits = np.repeat(have + new <= degree, new)
    graph[target[fits], place[fits]] = source[fits]
    over = np.flatnonzero(have + new > degree)
    over = over[np.argsort(new[over], kind="stable")]
    for s in range(0, len(over), TOGETHER):
        some = over[s : s + TOGETHER]
        wide = int((have[some] + new[some]).max())
        ids = np.full((len(some), wide), -1)
        for r, j in enumerate(some):
            ids[r, : have[j]] = graph[points[j], : have[j]]
            ids[r, have[j] : have[j] + new[j]] = source[first[j] : first[j] + new[j]]
        dist = squared(x, ids, x[points[some]])
        if wide > 4 * degree:  # of very many the nearest are enough to choose from
            near = np.argsort(np.where(ids < 0, np.inf, dist), axis=1, kind="stable")[:, : 4 * degree]
            ids, dist = np.take_along_axis(ids, near, 1), np.take_along_axis(dist, near, 1)
        graph[points[some]] = robust_prune(x, ids, dist, degree, alpha)


def _reached(graph: np.ndarray, start: int, seen: np.ndarray) -> None:
    front = np.array([start])
    seen[start] = True
    while len(front):
        near = np.unique(graph[front])
        near = near[near >= 0]
        front = near[~seen[near]]
        seen[front] = True


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = PROPOSED, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entries): edges of each point, -1 for none, with a last row of none, and the points where searches begin."""
    n = len(x)
    largest = float(np.abs(x).max())
    if 1e-12 < largest < 1e12:  # single precision is enough to propose and to prune
        x = x.astype(np.float32)
    graph = np.full((n + 1, degree), -1)
    start = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    entries = np.array([start])
    at = 1
    while at < n:
        some = order[at : at + min(at, TOGETHER)]
        at += len(some)
        ids, dist = beam_search(x, graph, entries, x[some], beam)
        if len(some) > 1:  # points that come together haven't got each other in the graph
            peers = np.broadcast_to(some, (len(some), len(some)))
            apart = squared(x, peers, x[some])
            near = np.argsort(apart, axis=1, kind="stable")[:, : degree + 1]
            ids, dist = np.concatenate([ids, np.take_along_axis(peers, near, 1)], axis=1), np.concatenate([dist, np.take_along_axis(apart, near, 1)], axis=1)
        chosen = robust_prune(x, np.where(ids == some[:, None], -1, ids), dist, degree, alpha)
        graph[some] = chosen
        source, place = np.nonzero(chosen >= 0)
        target = chosen[source, place]
        new = ~(graph[target] == some[source][:, None]).any(axis=1)
        _add_back(x, graph, some[source][new], target[new], alpha)
    seen = np.zeros(n, bool)
    _reached(graph, start, seen)
    found = [start]
    while not seen.all():
        found.append(int(np.argmin(seen)))
        _reached(graph, found[-1], seen)
    return graph, np.array(found)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances row by row, summed from the first component on."""
    return np.sqrt(np.cumsum((x - q) ** 2, axis=1)[:, -1])


INDEX = "dim int, shard int, cid binary, first binary, vectors binary, graph binary, entries binary"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points sorted by (dim, shard), (dim, shard, cid, first, embedding) -> one row per shard with its graph."""
    held: list[pa.Table] = []

    def made() -> pa.RecordBatch:
        table = pa.concat_tables(held).combine_chunks().sort_by("cid")
        dim, shard = table.column(0)[0].as_py(), table.column(1)[0].as_py()
        x = np.asarray(table.column("embedding").combine_chunks().flatten(), np.float64).reshape(-1, dim)
        graph, entries = build_graph(x)
        packed = {n: np.asarray(table.column(n), "<i8").tobytes() for n in ("cid", "first")}
        packed |= {"vectors": x.astype("<f8").tobytes(), "graph": graph.astype("<i4").tobytes(), "entries": entries.astype("<i4").tobytes()}
        return pa.record_batch({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32())} | {n: pa.array([v], pa.binary()) for n, v in packed.items()})

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column(0), np.int64) << 32 | np.asarray(batch.column(1), np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1), len(key)]
        for s, e in zip(cuts[:-1], cuts[1:]):
            part = pa.Table.from_batches([batch.slice(s, e - s)])
            if held and (held[-1].column(0)[0] != part.column(0)[0] or held[-1].column(1)[0] != part.column(1)[0]):
                yield made()
                held.clear()
            held.append(part)
    if held:
        yield made()


def _search(most: int, beam: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A shard's graph beside a block of queries -> (query, cid, first, score): the shard's ``most`` nearest of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                cid, first = (np.frombuffer(batch.column(n)[i].as_py(), "<i8") for n in ("cid", "first"))
                x = np.frombuffer(batch.column("vectors")[i].as_py(), "<f8").reshape(-1, dim)
                graph = np.frombuffer(batch.column("graph")[i].as_py(), "<i4").reshape(len(x) + 1, -1)
                entries = np.frombuffer(batch.column("entries")[i].as_py(), "<i4")
                asked = batch.column("asked")[i].values
                names = np.asarray(asked.field("query"), np.int64)
                q = np.asarray(asked.field("embedding").flatten(), np.float64).reshape(-1, dim)
                for s in range(0, len(q), TOGETHER):
                    ids, _ = beam_search(x, graph, entries, q[s : s + TOGETHER], beam)
                    row, place = np.nonzero(ids >= 0)
                    at = ids[row, place]
                    score = distances(x[at], q[s + row])
                    order = np.lexsort((first[at], score, row))
                    row, at, score = row[order], at[order], score[order]
                    rank = np.arange(len(row)) - np.searchsorted(row, row)
                    row, at, score = row[rank < most], at[rank < most], score[rank < most]
                    yield pa.record_batch({"query": pa.array(names[s + row]), "cid": pa.array(cid[at]), "first": pa.array(first[at]), "score": pa.array(score)})

    return run


def points(embeddings: DataFrame, most: int) -> DataFrame:
    """(cid, dim, first, ids, embedding): the distinct usable vectors, with the ``most`` smallest ids of each."""
    broken = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(broken, F.lit(True)) & F.exists("embedding", lambda v: v != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(usable).distinct()
    lowest = rows.withColumn("_n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("_n") <= most)
    held = lowest.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return held.select(F.monotonically_increasing_id().alias("cid"), F.size("embedding").alias("dim"), F.col("ids")[0].alias("first"), "ids", "embedding")


def graph_index(held: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row per shard of the points: their numbers, vectors, graph and entries."""
    ensure_shipped(held.sparkSession)
    tasks = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = F.least(F.lit(shard), F.greatest(F.lit(1), F.floor(SHARD_BYTES / (8 * F.col("dim"))))).cast("int")
    sizes = held.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / F.max(most)).cast("int").alias("shards"))
    dealt = held.join(sizes, "dim").select("dim", F.pmod(F.xxhash64("first", "cid"), F.col("shards")).cast("int").alias("shard"), "cid", "first", "embedding")
    dealt = dealt.repartition(tasks, "dim", "shard").sortWithinPartitions("dim", "shard", "cid")
    return dealt.mapInArrow(lean(_build), INDEX)


def nearest(embeddings: DataFrame, queries: DataFrame, top: int = TOP, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest other rows of each row of ``queries`` (vec_id, embedding), by
    Euclidean distance, nearest first, ties to the smaller vec_id. ``queries`` are rows of ``embeddings``.

    Every usable row is indexed and every query meets every shard; what is approximate is the search within a shard.

    Defined cases: null and zero vectors, vectors that hold a null or a non-finite component and rows without vec_id
    take no part; vectors of another length are no candidates; equal vectors are at distance 0; rows that repeat id and
    vector are one; an id with several vectors is as near as the nearest of them; rows that share their id with a query
    are never its candidates; fewer candidates than ``top`` give fewer rows; an empty table gives an empty result. Other columns are ignored.
    """
    return settled(embeddings.sparkSession, "nearest", lambda: _nearest(embeddings, queries, top, shard, beam))


def _nearest(embeddings: DataFrame, queries: DataFrame, top: int, shard: int, beam: int) -> DataFrame:
    held = materialize(points(embeddings, top + 1), "points")
    index = materialize(graph_index(held, shard), "graphs")
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).distinct()
    named = materialize(asked.join(held.select("cid", "embedding"), "embedding").select("query_id", F.col("cid").alias("query")), "queries")
    wanted = held.join(named.select(F.col("query").alias("cid")).distinct(), "cid", "left_semi").select("cid", "dim", "embedding")
    counts = wanted.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = wanted.join(counts, "dim").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    blocks = dealt.groupBy("dim", "block").agg(F.collect_list(F.struct(F.col("cid").alias("query"), "embedding")).alias("asked"))
    met = blocks.join(index.select("dim", "shard"), "dim").join(index, ["dim", "shard"]).select("dim", "cid", "first", "vectors", "graph", "entries", "asked")
    found = met.mapInArrow(lean(_search(top + 1, max(beam, top + 1))), "query long, cid long, first long, score double")
    best = Window.partitionBy("query").orderBy("score", "first", "cid")
    kept = found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= top + 1).select("query", "cid", "score")
    every = materialize(kept, "kept").join(held.select("cid", F.explode("ids").alias("vec_id")), "cid").join(named, "query").filter("vec_id <> query_id")
    every = every.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return every.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
