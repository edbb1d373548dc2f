"""Near copies by SimHash: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

64-bit SimHashes of such texts differ in some ten bits, and values so far apart need share no block of bits that selects.
So the BK-trees' shards are dealt by min-hashes instead: a text is in one shard per band, whose key holds ROWS min-hashes
of its shingles, and two texts of similarity 0.8 meet in one of the BANDS shards with a probability of 0.9993, more
similar ones sooner. All pairs come from searches of the shards' BK-trees of SimHashes within RADIUS bits, in two rounds,
and are verified on whole sets:

* in every shard members search the tree in turn, the first one (the hub) before the others; who is found by one that
  searched needn't search any more, so that a dense group is tied together in linear work;
* where a shard's members are not all tied to the hub after that, over whatever chain of links, those that aren't search
  the tree for all members of other groups.

Before whole sets are read, two bounds drop pairs: the sizes, and parities of the shingles per bucket, which two sets
can't have differ in more buckets than they differ in shingles. A pair of a tied group is never listed. A shard of
very many members is several trees, each with the hub as its root.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.shipping import ensure_shipped

from .common import join_checked, lean, materialize, settled
from .components import connected_components
from .passages import CHUNK, WIDTH, _mix, shingles
from .simhash import Forest

BANDS, ROWS = 24, 6
#: Bits that SimHashes of texts of similarity 0.8 differ in at most but for one in a few thousand; the mean is 10.
RADIUS = 24
#: Buckets whose parities are compared.
BUCKETS = 1024
#: Members of a tree; shards with more are searched in parts.
TREE = 1024
_MULTIPLIERS = (_mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SPACES = re.compile(rb"[\x20\x09-\x0D]")


def cut(raw: bytes) -> Iterator[bytes]:
    """Pieces of a long text of some CHUNK bytes that overlap by four words, so that each shingle is in one."""
    start, reach = 0, CHUNK
    while len(raw) - start > reach:
        space = _SPACES.search(raw, start + reach)
        parts = raw[start : space.start()].rsplit(None, WIDTH - 1) if space else []
        if len(parts) == WIDTH:
            yield raw[start : space.start()]
            start, reach = start + len(parts[0]), CHUNK
        else:
            reach *= 2
    yield raw[start:]


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted hashes of each text's five-word shingles; fewer words are one shingle, and no words the shingle 0."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    short = [i for i, text in enumerate(raw) if len(text) <= CHUNK]
    hashed, first = shingles([raw[i] for i in short])
    found = dict(zip(short, (hashed[a:b] for a, b in zip(first, first[1:]))))
    out = []
    for i, text in enumerate(raw):
        own = found[i] if i in found else np.concatenate([np.unique(shingles([x])[0]) for x in cut(text)])
        own = np.unique(own[own > 0])
        if not len(own):
            words = b" ".join(text.lower().split())
            own = np.array([xxhash.xxh64_intdigest(words) | 1 if words else 0], np.uint64)
        out.append(own)
    return out


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(row, text) -> rows and sets of a bounded number of bytes."""
    rows, texts, size = [], [], 0
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows.append(row)
            texts.append(text.as_py())
            size += len(texts[-1] or "") + 1
            if size >= CHUNK:
                yield rows, shingle_sets(texts)
                rows, texts, size = [], [], 0
    if texts:
        yield rows, shingle_sets(texts)


def simhash_of(own: np.ndarray) -> int:
    """The SimHash of a set of hashes: a bit is set if over half of them have it."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(own), 1 << 14):
        part = own[start : start + (1 << 14)]
        counts += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(len(part), 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(own)).tobytes(), "big")


def parities(own: np.ndarray) -> bytes:
    """A bit per bucket: whether an odd number of the shingles is there."""
    bucket = ((own >> np.uint64(8)) % np.uint64(BUCKETS)).astype(np.int64)
    return np.packbits(np.bincount(bucket, minlength=BUCKETS) & 1).tobytes()


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key per band: the number of the band and its min-hashes."""
    high = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(high), 1 << 11):
        least = np.minimum(least, (_MULTIPLIERS[:, None] * high[None, start : start + (1 << 11)]).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _mix(key + column)
    return key.view(np.int64)


SKETCH = "row long, same binary, fp long, size int, parities binary, keys array<long>"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, sets in _some(batches):
        yield pa.record_batch({
            "row": pa.array(rows, pa.int64()), "same": pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()),
            "fp": pa.array(np.fromiter(map(simhash_of, sets), np.uint64, len(sets)).view(np.int64)), "size": pa.array([len(x) for x in sets], pa.int32()),
            "parities": pa.array(map(parities, sets), pa.binary()), "keys": pa.array([band_keys(x) for x in sets], pa.list_(pa.int64())),
        })


def _bits(column: pa.Array) -> np.ndarray:
    """Parities as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), BUCKETS // 64)


def may_be_similar(size: np.ndarray, bits: np.ndarray, other_size: np.ndarray, other_bits: np.ndarray) -> np.ndarray:
    """False only where sizes or parities exclude a similarity of 0.8."""
    total = size + other_size
    ok = 9 * np.minimum(size, other_size) >= 4 * total
    ok[ok] = 9 * np.bitwise_count(bits[ok] ^ other_bits[ok]).sum(axis=1, dtype=np.int64) <= total[ok]
    return ok


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sizes, parities, SimHashes of both) -> the pairs (a, b) that may be similar."""
    for batch in batches:
        size, other = (np.asarray(batch.column(i), np.int64) for i in (2, 3))
        ok = may_be_similar(size, _bits(batch.column(4)), other, _bits(batch.column(5)))
        ok &= np.bitwise_count((np.asarray(batch.column(6)) ^ np.asarray(batch.column(7))).view(np.uint64)) <= RADIUS
        yield batch.select(["a", "b"]).filter(pa.array(ok))


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, sets in _some(batches):
        yield pa.record_batch({"row": pa.array(rows, pa.int64()), "own": pa.array([x.tobytes() for x in sets], pa.binary())})


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, set of a, set of b) -> the pairs (a, b) of similarity 0.8 or more."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            keep[i] = 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _by_cell(batches: Iterator[pa.RecordBatch], found: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is found in rows by cell (key, part, ...), which get a column ``cell``; a cell cut by the end of a batch waits for the next."""
    held: pa.Table | None = None

    def numbered(table: pa.Table) -> pa.Table:
        key, part = (np.asarray(table.column(n).combine_chunks()) for n in ("key", "part"))
        new = np.r_[False, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]
        return table.append_column("cell", pa.array(np.cumsum(new), pa.int64()))

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = numbered(table if held is None else pa.concat_tables([held, table]))
        cell = np.asarray(table.column("cell").combine_chunks())
        end = int(np.searchsorted(cell, cell[-1]))
        if end:
            yield found(table.slice(0, end))
        held = table.slice(end).drop_columns(["cell"])
    if held is not None:
        yield found(numbered(held))


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by cell (key, part, row, fp), the hub first -> pairs (a, b) within RADIUS that the members' searches of their cell's BK-tree give.

    Members search in their order, twice as many of a cell at each turn, but none that an earlier turn has found.
    """

    def found(table: pa.Table) -> pa.RecordBatch:
        row, fp, cell = (np.asarray(table.column(n).combine_chunks()) for n in ("row", "fp", "cell"))
        fp = fp.view(np.uint64)
        forest = Forest(cell, fp)
        free, most = np.arange(len(row)), 1
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(free):
            first = np.r_[True, cell[free[1:]] != cell[free[:-1]]]
            asks = np.arange(len(free)) - np.flatnonzero(first)[np.cumsum(first) - 1] < most
            asking, met = free[asks], np.zeros(len(row), bool)
            for start in range(0, len(asking), 256):  # so that the pairs held at a time stay few
                own = asking[start : start + 256]
                who, node = forest.search(fp[own], forest.root[own], RADIUS)
                met[node] = True
                x, y = row[own[who]], row[node]
                a.append(np.minimum(x, y)[x != y])
                b.append(np.maximum(x, y)[x != y])
            free, most = free[~asks & ~met[free]], 2 * most
        return pa.record_batch({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})

    return _by_cell(batches, found)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by cell (key, part, row, root, asks, member, fp, size, parities, keys) -> pairs (a, b) of different roots near each other.

    A cell's members are a BK-tree, which the rows that ask search.
    A pair is given once: of the shards it shares by the first, and if both ask by the smaller.
    """

    def found(table: pa.Table) -> pa.RecordBatch:
        col = {n: table.column(n).combine_chunks() for n in ("row", "root", "asks", "member", "fp", "size", "cell")}
        row, root, fp, size, cell = (np.asarray(col[n]) for n in ("row", "root", "fp", "size", "cell"))
        asks, member = (col[n].to_numpy(zero_copy_only=False) for n in ("asks", "member"))
        key = np.asarray(table.column("key").combine_chunks())
        keys = np.asarray(table.column("keys").combine_chunks().flatten()).reshape(len(row), -1)
        bits, size = _bits(table.column("parities").combine_chunks()), size.astype(np.int64)
        inside = np.flatnonzero(member)
        forest = Forest(cell[inside], fp[inside].view(np.uint64))
        asking = np.flatnonzero(asks)
        names, first = np.unique(cell[inside], return_index=True)
        place = np.minimum(np.searchsorted(names, cell[asking]), max(len(names) - 1, 0))
        asking = asking[names[place] == cell[asking]] if len(names) else asking[:0]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start in range(0, len(asking), 256):  # so that the pairs held at a time stay few
            own = asking[start : start + 256]
            who, node = forest.search(fp[own].view(np.uint64), first[np.searchsorted(names, cell[own])], RADIUS)
            x, y = own[who], inside[node]
            new = (root[x] != root[y]) & ~(asks[y] & (row[y] < row[x]))
            x, y = x[new], y[new]
            ok = may_be_similar(size[x], bits[x], size[y], bits[y])
            x, y = x[ok], y[ok]
            first_shared = (keys[x] == keys[y]).argmax(axis=1)
            ok = keys[x, first_shared] == key[x]
            a.append(np.minimum(row[x[ok]], row[y[ok]]))
            b.append(np.maximum(row[x[ok]], row[y[ok]]))
        return pa.record_batch({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})

    return _by_cell(batches, found)


def _beside(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with columns of both rows."""
    for x in "ab":
        pairs = pairs.join(of.select(F.col("row").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns)), x)
    return pairs.select("a", "b", *(f"{c}_{x}" for c in columns for x in "ab"))


def _verified(docs: DataFrame, sketches: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows whose whole sets are similar."""
    left = materialize(_beside(pairs.distinct(), sketches, "size", "parities", "fp").mapInArrow(lean(_sift), "a long, b long"), "sifted")
    asked = materialize(left.select("a").union(left.select("b")).distinct().withColumnRenamed("a", "row"), "asked")
    sets = materialize(join_checked(docs, asked, "row", "left_semi", rows=200_000).mapInArrow(lean(_whole_sets), "row long, own binary"), "sets")
    return materialize(_beside(left, sets, "own").mapInArrow(lean(_similar), "a long, b long"), "similar")


def _roots(links: DataFrame) -> DataFrame:
    return connected_components(links).select(F.col("node").alias("row"), "root")


def near_copies(docs: DataFrame) -> DataFrame:
    """(row, first) of documents (row, text), ``row`` a unique long: first is the smallest row reachable over near copies.

    Defined cases: texts without words (null too) are copies of each other; a text with fewer words than a shingle is
    one shingle; case of ASCII letters and the kind of white space make no difference; equal sets are equal texts; very
    long texts are hashed piece by piece; an empty input gives an empty result. Other columns are ignored.
    """
    ensure_shipped(docs.sparkSession)
    return settled(docs.sparkSession, "near_copies", lambda: _near_copies(docs.select("row", "text")))


def _near_copies(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    made = materialize(docs.mapInArrow(lean(_sketches), SKETCH), "sketches")
    rows = made.select("row", "same")
    firsts = materialize(rows.groupBy("same").agg(F.min("row").alias("row")), "firsts")
    copies = materialize(rows.join(firsts, ["row", "same"], "left_anti").select("row"), "copies")
    sketches = join_checked(made.select("row", "fp", "size", "parities", "keys"), copies, "row", "left_anti")
    in_shards = sketches.select("row", "fp", F.explode("keys").alias("key"))
    shards = in_shards.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("hub")).filter("n > 1")
    members = materialize(join_checked(in_shards, materialize(shards, "shards"), "key"), "members")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = F.ceil(F.col("n") / TREE).cast("int")
    own = F.pmod(F.xxhash64("row"), parts).cast("int")
    # The hub is in every part of its shard.
    inside = F.explode(F.when(F.col("row") == F.col("hub"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own)))
    trees = members.select("key", inside.alias("part"), "row", "fp").repartition(tasks, "key", "part").sortWithinPartitions("key", "part", "row")
    links = _verified(docs, sketches, trees.mapInArrow(lean(_lead), "a long, b long"))
    roots = _roots(links)
    # Shards with members that no links tie to the hub.
    named = members.join(roots, "row", "left").select("key", "row", "hub", "n", F.coalesce("root", "row").alias("root"))
    at_hub = named.filter("row = hub").select("key", F.col("root").alias("hub_root"))
    named = materialize(join_checked(named, materialize(at_hub, "hubs"), "key"), "named")
    open_ = materialize(named.filter("root <> hub_root").select("key").distinct(), "open")
    stray = named.select("*", (F.col("root") != F.col("hub_root")).alias("asks"), parts.alias("parts"), own.alias("own"))
    stray = join_checked(stray, open_, "key", "left_semi")
    every = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
    cells = stray.select("key", "row", "root", "asks", "own", F.explode(every).alias("part")).withColumn("member", F.col("part") == F.col("own"))
    cells = cells.join(sketches, "row").select("key", "part", "row", "root", "asks", "member", "fp", "size", "parities", "keys")
    cells = cells.repartition(tasks, "key", "part").sortWithinPartitions("key", "part", "row")
    late = _verified(docs, sketches, cells.mapInArrow(lean(_search), "a long, b long"))
    if late.limit(1).count():
        roots = _roots(links.union(late))
    least = roots.groupBy("root").agg(F.min("row").alias("least"))
    least = roots.join(least, "root").select("row", "least")
    first = firsts.join(least, "row", "left").select("same", F.coalesce("least", "row").alias("first"))
    return rows.join(first, "same").select("row", "first")
