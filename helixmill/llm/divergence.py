"""Source divergence audit over an integer dictionary of terms.

Workers count terms per language and source; the counts are summed in Spark. Terms in enough documents of a language are
kept. Their keys (language, term) are ordered by UTF-8 bytes over all partitions and cut into chunks of consecutive ids;
the first key of each chunk, cut to KEY_BYTES, tells any term its chunk. A chunk's task holds the chunk's sorted array of
kept terms: ``searchsorted`` gives a term its id, and a bincount per group turns counts into a dense vector whose order is
that of the terms' bytes, so that ties need no look at the terms. Groups are then compared chunk by chunk in blocks of
sources, in exact integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.shipping import ensure_shipped

from .common import global_rank, lean, materialize, settled, union_all

LEAST_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Terms of a chunk at least, chunks at most (a larger vocabulary has larger chunks), bytes of a chunk's first key.
CHUNK, CHUNKS, KEY_BYTES = 1024, 1 << 15, 256
#: Sources of a block, and numbers of a block's dense vectors at most.
BLOCK, CELLS = 256, 1 << 20
#: Counted terms and bytes that a worker holds before it passes them on.
HELD, HELD_BYTES = 200_000, 32 << 20
#: Totals up to this are scaled exactly in 64 bits.
LARGEST = (1 << 63) // 1000 - 1

_TERM = bytes(c if c >= 0x80 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of letters a-z and of all beyond ASCII, only A-Z lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs): occurrences and documents of terms, of many documents summed."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            names = list(n)
            yield pa.record_batch({
                "lang": pa.array([lang] * len(n), pa.string()), "source": pa.array([source] * len(n), pa.string()), "term": pa.array(names, pa.binary()),
                "n": pa.array(n.values(), pa.int64()), "docs": pa.array([docs[t] for t in names], pa.int64()),
            })
        held.clear()

    size = weight = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = text.as_py()
            words = terms(text)
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            n.update(words)
            docs.update(set(words))
            size += len(n) - before
            weight += len(text) if len(n) > before else 0
            if size >= HELD or weight >= HELD_BYTES:
                yield from told()
                size = weight = 0
    yield from told()


def scaled(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * count / total), exact by long division in three digits to the base 1000."""
    if total > LARGEST:
        raise OverflowError("a group has too many terms for exact 64-bit shares")
    rest, out = count.astype(np.int64), np.zeros(len(count), np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def dense(ids: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The vector of counts by id; counts beyond 2**53 would be lost in a weighted bincount, so it sums halves of 26 bits."""
    low, high = counts & (1 << 26) - 1, counts >> 26
    return np.bincount(ids, low, size).astype(np.int64) + (np.bincount(ids, high, size).astype(np.int64) << 26)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / q); p and q reach 1e9 + 1, so squares fit 64 bits."""
    apart = p - q
    return apart * apart // q


ENCODED = "lang string, chunk int, source string, size int, ids binary, counts binary"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (chunk, lang, kept first, source), (chunk, lang, source, term, n), source null for a kept term ->
    a row per chunk, language and source with the ids and counts of its terms, and one with source null and the terms."""
    now: tuple | None = None
    known: list[bytes] = []
    array: np.ndarray | None = None
    source, found, counts = None, [], []
    made: list[tuple] = []

    def group() -> None:
        nonlocal found, counts
        if found:
            some, n = np.array(found, object), np.array(counts, np.int64)
            at = np.minimum(np.searchsorted(array, some), len(array) - 1) if len(array) else np.zeros(len(some), np.int64)
            kept = (array[at] == some).astype(bool) if len(array) else np.zeros(len(some), bool)
            if kept.any():
                vector = dense(at[kept], n[kept], len(array))
                ids = np.flatnonzero(vector)
                made.append((now[1], now[0], source, len(array), ids.astype("<i4").tobytes(), vector[ids].astype("<i8").tobytes()))
        found, counts = [], []

    def passed() -> pa.RecordBatch:
        columns = list(zip(*made))
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary())
        return pa.record_batch({n: pa.array(c, k) for n, c, k in zip(("lang", "chunk", "source", "size", "ids", "counts"), columns, kinds)})

    for batch in batches:
        chunk, lang, of, term, n = (batch.column(i).to_pylist() for i in range(5))
        for i in range(len(chunk)):
            if now != (chunk[i], lang[i]):
                group()
                now, known, array, source = (chunk[i], lang[i]), [], None, None
            if of[i] is None:
                known.append(term[i])
                continue
            if array is None:
                array = np.empty(len(known), object)
                array[:] = known
            if of[i] != source:
                group()
                source = of[i]
            found.append(term[i])
            counts.append(n[i])
        if made:
            yield passed()
            made = []
    group()
    if made:
        yield passed()


def _key():
    """Orders terms by language, then by their bytes: no term holds a zero byte."""
    return F.concat(F.encode("lang", "UTF-8"), F.lit(b"\0"), F.col("term"))


def _dealt(bounds: list[bytes]):
    """Adds the chunk of each row's key (first column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.empty(len(bounds), object)
        first[:] = bounds
        for batch in batches:
            key = np.empty(batch.num_rows, object)
            key[:] = batch.column(0).to_pylist()
            chunk = np.maximum(np.searchsorted(first, key, side="right") - 1, 0)
            yield pa.record_batch({"chunk": pa.array(chunk, pa.int32())} | {n: batch.column(n) for n in batch.schema.names[1:]})

    return run


def _vectors(rows: list[tuple], size: int) -> tuple[np.ndarray, np.ndarray]:
    """p of the groups of a block over a chunk, and whether they have the term; rows (.., total, ids, counts)."""
    p, there = np.zeros((len(rows), size), np.int64), np.zeros((len(rows), size), bool)
    for i, (total, ids, counts) in enumerate(rows):
        vector = dense(np.frombuffer(ids, "<i4"), np.frombuffer(counts, "<i8"), size) if ids else np.zeros(size, np.int64)
        there[i] = vector > 0
        p[i] = scaled(vector + 1, total) if size else vector
    return p, there


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (lang, chunk, first, second), each chunk's groups in two blocks (block, source, size, total, ids, counts)
    -> (lang, source, item, value): for each group and other group of its language, their divergence over the chunk."""
    key, sides = None, ([], [])

    def told() -> Iterator[pa.RecordBatch]:
        lang, _, first, second = key
        size = sides[0][0][0] if sides[0] else 0
        (one, p), (two, q) = (([r[1] for r in side], _vectors([r[2:] for r in side], size)[0]) for side in sides)
        for a, x, b, y in ((one, p, two, q), (two, q, one, p)):
            for source, v in zip(a, x):
                value = divergence(v, y).sum(axis=1) if len(b) else np.zeros(0, np.int64)
                other = [i for i, item in enumerate(b) if item != source]
                yield pa.record_batch({"lang": pa.array([lang] * len(other), pa.string()), "source": pa.array([source] * len(other), pa.string()), "item": pa.array([b[i] for i in other], pa.string()), "value": pa.array(value[other])})
            if first == second:
                break

    for batch in batches:
        lang, chunk, first, second, block, source, size, total, ids, counts = (batch.column(i).to_pylist() for i in range(10))
        for i in range(len(lang)):
            if key != (lang[i], chunk[i], first[i], second[i]):
                if key is not None:
                    yield from told()
                key, sides = (lang[i], chunk[i], first[i], second[i]), ([], [])
            row = (size[i], source[i], total[i], ids[i], counts[i])
            if block[i] == first[i]:
                sides[0].append(row)
            if block[i] == second[i]:
                sides[1].append(row)
    if key is not None:
        yield from told()


def _leading(top: int):
    """Rows sorted by (chunk, lang, own row first), of groups (source, size, total, ids, counts), of the language itself
    (source null) -> the chunk's ``top`` terms of each group, by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = None
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(7)))
            made: list[tuple] = []
            for lang, chunk, source, size, total, ids, counts in rows:
                (p,), (there,) = _vectors([(total, ids, counts)], size)
                if source is None:
                    q = p
                    continue
                at = np.flatnonzero(there & (p > q))
                value = divergence(p[at], q[at])
                best = np.lexsort((at, -value))[:top]
                made += [(lang, chunk, source, int(at[j]), int(value[j])) for j in best]
            if made:
                columns = zip(*made)
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64())
                yield pa.record_batch({n: pa.array(c, k) for n, c, k in zip(("lang", "chunk", "source", "id", "value"), columns, kinds)})

    return run


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from the others, and by which terms.

    Part ``pair`` ranks the other sources of the language by their divergence, part ``term`` the ``top`` terms that are
    more frequent in the source than in its language. Shares are p = 1 + floor(1e9 * (count + 1) / (N + V)) of the V
    kept terms, divergences floor((p - q) ** 2 / q), all in exact integers; ties go to the smaller UTF-8 bytes.

    Defined cases: null texts, languages and sources are read as ''; a source without other sources has no pairs, one
    without terms takes part; a language without kept terms has pairs of value 0; repeated rows are documents of their
    own, whatever their ids; very long texts and terms are counted whole; an empty table gives an empty result. Other
    columns are ignored.
    """
    return settled(docs.sparkSession, "audit", lambda: _audit(docs, least_docs, top, chunk, block))


def _audit(docs: DataFrame, least_docs: int, top: int, chunk: int, block: int) -> DataFrame:
    spark = docs.sparkSession
    ensure_shipped(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = docs.select(*(F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in ("lang", "source", "text")))
    counted = read.mapInArrow(lean(_count), "lang string, source string, term binary, n long, docs long")
    counted = materialize(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counted")
    kept = materialize(counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term", _key().alias("key")), "kept")
    wide = max(chunk, -(-kept.count() // CHUNKS))
    ranked = materialize(global_rank(kept, [F.col("key")], "id"), "ranked")
    bounds = sorted({bytes(r[0]) for r in ranked.filter(F.col("id") % wide == 0).select(F.substring("key", 1, KEY_BYTES)).collect()})
    # terms meet the sorted array of their chunk
    rows = counted.select(_key().alias("key"), "lang", "source", "term", "n").union(kept.select("key", "lang", F.lit(None).cast("string"), "term", F.lit(0).cast("long")))
    dealt = rows.mapInArrow(lean(_dealt(bounds)), "chunk int, lang string, source string, term binary, n long")
    dealt = dealt.repartition(tasks, "chunk").sortWithinPartitions("chunk", "lang", F.col("source").asc_nulls_first(), "term")
    encoded = materialize(dealt.mapInArrow(lean(_encode), ENCODED), "encoded")
    sizes = encoded.groupBy("lang", "chunk").agg(F.max("size").alias("size"))
    # groups, and each language as a group of its own (source null)
    sums = _summed(encoded)
    vocabulary = sizes.groupBy("lang").agg(F.sum("size").alias("v"))
    names = read.select("lang", "source").distinct()
    groups = names.join(sums, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = materialize(groups.select("lang", "source", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("v", F.lit(0)).cast("long").alias("v")), "groups")
    own = groups.groupBy("lang").agg((F.sum("n") + F.max("v")).alias("total"), F.count(F.lit(1)).alias("sources"))
    return union_all([_pairs(groups, own, sizes, encoded, min(block, max(1, CELLS // wide)), tasks), _terms(groups, own, sizes, encoded, kept, bounds, top, tasks)])


def _count_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [int(np.frombuffer(x.as_py(), "<i8").sum()) for x in batch.column(2)]
        yield pa.record_batch({"lang": batch.column(0), "source": batch.column(1), "n": pa.array(n, pa.int64())})


def _summed(encoded: DataFrame) -> DataFrame:
    """(lang, source, n): occurrences of kept terms."""
    return encoded.select("lang", "source", "counts").mapInArrow(lean(_count_sum), "lang string, source string, n long").groupBy("lang", "source").agg(F.sum("n").alias("n"))


def _pairs(groups: DataFrame, own: DataFrame, sizes: DataFrame, encoded: DataFrame, block: int, tasks: int) -> DataFrame:
    blocks = F.ceil(F.col("sources") / block).cast("int")
    told = groups.join(own.filter("sources > 1").select("lang", "sources"), "lang").select("lang", "source", (F.col("n") + F.col("v")).alias("total"), blocks.alias("blocks"))
    told = told.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    # every group has a vector in every chunk of its language; a language without kept terms has one empty chunk
    cells = told.join(sizes, "lang", "left").select("lang", F.coalesce("chunk", F.lit(-1)).alias("chunk"), "source", F.coalesce("size", F.lit(0)).alias("size"), "total", "blocks", "block")
    cells = cells.join(encoded.select("lang", "chunk", "source", "ids", "counts"), ["lang", "chunk", "source"], "left")
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("lang", "chunk", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "source", "size", "total", "ids", "counts")
    keys = ["lang", "chunk", "first", "second"]
    compared = cells.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(lean(_compare), "lang string, source string, item string, value long")
    whole = compared.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return whole.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _summed_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (lang, chunk) -> the language's own counts beside its groups': the vectors of the chunk added up, source null."""
    key, total, size = None, None, 0

    def told() -> pa.RecordBatch:
        ids = np.flatnonzero(total)
        return pa.record_batch({
            "lang": pa.array([key[0]], pa.string()), "chunk": pa.array([key[1]], pa.int32()), "source": pa.array([None], pa.string()), "size": pa.array([size], pa.int32()),
            "ids": pa.array([ids.astype("<i4").tobytes()], pa.binary()), "counts": pa.array([total[ids].astype("<i8").tobytes()], pa.binary()),
        })

    for batch in batches:
        for lang, chunk, wide, ids, counts in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))):
            if key != (lang, chunk):
                if key is not None:
                    yield told()
                key, total, size = (lang, chunk), np.zeros(wide, np.int64), wide
            total += dense(np.frombuffer(ids, "<i4"), np.frombuffer(counts, "<i8"), wide)
    if key is not None:
        yield told()


def _terms(groups: DataFrame, own: DataFrame, sizes: DataFrame, encoded: DataFrame, kept: DataFrame, bounds: list[bytes], top: int, tasks: int) -> DataFrame:
    dealt = encoded.repartition(tasks, "lang", "chunk").sortWithinPartitions("lang", "chunk", "source")
    language = dealt.mapInArrow(lean(_summed_chunks), ENCODED).join(own.select("lang", "total"), "lang")
    of = encoded.join(groups.select("lang", "source", (F.col("n") + F.col("v")).alias("total")), ["lang", "source"])
    columns = ["lang", "chunk", "source", "size", "total", "ids", "counts"]
    both = language.select(*columns).union(of.select(*columns)).repartition(tasks, "lang", "chunk")
    both = both.sortWithinPartitions("lang", "chunk", F.col("source").asc_nulls_first())
    leading = both.mapInArrow(lean(_leading(top)), "lang string, chunk int, source string, id int, value long")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "chunk", "id")
    best = leading.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    named = kept.select("key", "lang", "term").mapInArrow(lean(_dealt(bounds)), "chunk int, lang string, term binary")
    named = named.withColumn("id", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    return best.join(named, ["lang", "chunk", "id"]).select("lang", "source", F.lit("term").alias("part"), F.decode("term", "UTF-8").alias("item"), "value", "rank")
