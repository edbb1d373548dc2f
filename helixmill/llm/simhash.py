"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming radius through BK-trees.

Distinct fingerprints are dealt into shards by blocks of bits that two fingerprints within the radius must share
(pigeonhole), each shard holds a BK-tree whose children are keyed by their integer distance to the parent, and a
search follows only edges whose key differs from its own distance by at most the radius. A shard lives where its
members live: copying all trees to all executors would broadcast data that grows with the corpus. Shards with more
members than a tree should hold are linked exactly in another way: two fingerprints differ in at most two bits if and
only if some value lies within one bit of both, and at most 65 fingerprints meet at a value.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.shipping import ensure_shipped

from .common import join_checked, map_arrow, materialize
from .components import connected_components

BITS = 64
SEED = 42
#: Shingles whose digests are unpacked at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned SimHash of a text: a bit is set if over half of the shingles' XXH64 have it; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
        total = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
        total = len(words) - width + 1
    counts = np.zeros(BITS, np.int64)
    digests = map(xxhash.xxh64_digest, shingles, repeat(SEED))
    for start in range(0, total, CHUNK):
        n = min(CHUNK, total - start)
        raw = np.frombuffer(b"".join(next(digests) for _ in range(n)) if n < total else b"".join(digests), np.uint8)
        counts += np.unpackbits(raw).reshape(n, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of each document; fp holds the 64 bits as a signed long."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
        return pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(made.view(np.int64))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), of, f"doc_id {kind}, fp long")


def block_masks(parts: int, radius: int) -> list[int]:
    """Masks of which two values within the radius agree on at least one: any ``parts - radius`` of ``parts`` blocks."""
    cuts = [round(i * BITS / parts) for i in range(parts + 1)]
    blocks = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(parts)]
    return [sum(c) for c in combinations(blocks, parts - radius)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


class Forest:
    """BK-trees over the members of many shards, built and searched level by level in numpy.

    The first member of a shard is its root. A node's child at key k is the first member that reached the node with
    distance k; (node, k) pairs are kept sorted.
    """

    def __init__(self, shard: np.ndarray, values: np.ndarray):
        self.values = values
        first = np.r_[True, shard[1:] != shard[:-1]] if len(shard) else np.zeros(0, bool)
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1] if len(shard) else np.zeros(0, np.int64)
        moving, at = np.flatnonzero(~first), self.root[~first]
        keys, kids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(moving):
            key = at * (BITS + 1) + np.bitwise_count(values[moving] ^ values[at])
            found, where, back = np.unique(key, return_index=True, return_inverse=True)
            keys.append(found)
            kids.append(moving[where])
            at = moving[where][back]
            stay = np.ones(len(moving), bool)
            stay[where] = False
            moving, at = moving[stay], at[stay]
        keys_, kids_ = np.concatenate(keys), np.concatenate(kids)
        order = np.argsort(keys_)
        self.keys, self.kids = keys_[order], kids_[order]

    def search(self, asks: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in asks, member) within the radius, each ask searched for in the tree of its root in ``nodes``.

        By the triangle inequality only edges whose key differs from the ask's distance by at most the radius are
        followed; these are neighbours in the sorted edges.
        """
        who = np.arange(len(asks))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(who):
            gap = np.bitwise_count(asks[who] ^ self.values[nodes]).astype(np.int64)
            hit = gap <= radius
            left.append(who[hit])
            right.append(nodes[hit])
            base = nodes * (BITS + 1)
            low = np.searchsorted(self.keys, base + np.maximum(gap - radius, 0))
            n = np.searchsorted(self.keys, base + np.minimum(gap + radius, BITS), side="right") - low
            who = np.repeat(who, n)
            nodes = self.kids[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)]
        return np.concatenate(left), np.concatenate(right)

    def within(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All ordered pairs of different members of a shard within the radius."""
        left, right = self.search(self.values, self.root, radius)
        return left[left != right], right[left != right]


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n items."""
    root = np.arange(n)
    while len(left):
        new = root.copy()
        np.minimum.at(new, left, root[right])
        np.minimum.at(new, right, root[left])
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _tree_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard; a shard cut by the end of a batch waits for the next."""
        held = np.zeros((3, 0), np.int64)

        def linked(rows: np.ndarray) -> pa.RecordBatch:
            shard = np.cumsum(np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])
            values = np.ascontiguousarray(rows[2]).view(np.uint64)
            root = local_roots(len(values), *Forest(shard, values).within(radius))
            far = np.flatnonzero(root != np.arange(len(root)))
            return pa.record_batch({"a": pa.array(rows[2][root[far]]), "b": pa.array(rows[2][far])})

        for batch in batches:
            rows = np.concatenate([held, np.stack([np.asarray(c, np.int64) for c in batch.columns])], axis=1)
            last = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
            cut = len(last) - np.count_nonzero(last)
            if cut:
                yield linked(rows[:, :cut])
            held = rows[:, cut:]
        if held.shape[1]:
            yield linked(held)

    return run


def link_fingerprints(prints: DataFrame, shard_rows: int = 1024, rows_per_task: int = 500_000) -> DataFrame:
    """Links (a, b) that connect just the distinct fingerprints ``fp`` connected by steps of 2 or fewer bits."""
    ensure_shipped(prints.sparkSession)
    radius = 2
    n = prints.count()
    parts = next((p for p, most in ((3, 1 << 24), (4, 1 << 35)) if n <= most), 5)
    masks = block_masks(parts, radius)
    keyed = prints.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("s")
    ).select(F.col("s.mask").cast("long").alias("mask"), "s.key", "fp")
    full = materialize(keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_rows).select("mask", "key"), "full")
    tasks = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(masks) // rows_per_task + 1)
    shards = join_checked(keyed, full, ["mask", "key"], "left_anti").repartition(tasks, "mask", "key").sortWithinPartitions("mask", "key", "fp")
    links = shards.mapInArrow(_tree_links(radius), "a long, b long")
    # The shards too large for a tree: meet at values one bit away.
    crowded = join_checked(keyed, full, ["mask", "key"], "left_semi").select("fp").distinct()
    near = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.expr("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    met = crowded.select("fp", F.explode(F.concat(F.array("fp"), near)).alias("value"))
    met = met.groupBy("value").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return links.union(stars)


def near_duplicates(docs: DataFrame, width: int = 3, **options) -> DataFrame:
    """(doc_id, fp, component_id): fingerprints within 2 bits link, a component is named by its smallest doc_id.

    Defined cases: a text without words (null too) has fingerprint zero, linked like any other; texts with fewer words
    than a shingle are one shingle; repeated rows share their fingerprint; a null doc_id never names a component that
    has another; an empty input gives an empty result. Other columns are ignored.
    """
    prints = materialize(fingerprints(docs, width), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(link_fingerprints(distinct.select("fp"), **options))
    member = roots.select(F.col("node").alias("fp"), "root")
    named = distinct.join(member, "fp")
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    named = named.join(least, "root").select("fp", "least")
    of = distinct.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    """16 lowercase hex digits of a signed long's bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
