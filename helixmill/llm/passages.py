"""Substring dedup with compact windows.

The elements of a text are its five-word shingles. Under a hash function each shingle is a node of a Cartesian tree (the
smallest hash on top), and its subtree spans the compact window: all subsequences inside it that hold the shingle
share that min-hash. Only windows wide enough for the shortest passage (50 words) are kept, some two per passage length
and hash function. Windows of two texts meet if their minima and the shingles next to these agree; the interval join
keeps pairs whose windows reach far enough to both sides for a common passage, and the words around are fetched from both
texts and compared shingle by shingle in 64 bits, one word of shift allowed: 0.8 of some passage's shingles must agree.

Among the windows that meet at a key the first one serves as the hub the others are compared with, so that work and links
grow with the number of windows and not with its square. Windows that don't agree with their hub meet again, dealt to
finer keys: min-hashes of the shingles on either side of the minimum, one of which two windows of a common passage share
but for a few in a thousand. A passage that repeats inside one text is found in the same way. Copies of a text are one
text throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.shipping import ensure_shipped

from .common import join_checked, lean, materialize, settled
from .components import connected_components

WIDTH = 5
#: Shingles of the shortest passage, 50 words.
SHORTEST = 46
HASHES = 4
SIMILAR = 0.8
#: Shingles on either side of a minimum that must agree for windows to meet, and that are compared afterwards.
NEAR, FAR = 2, 45
#: Places whose surroundings are fetched and compared together.
STRETCH = 96
#: Windows that don't agree with their hub meet again by FINER min-hashes of HALF shingles on either side of the minimum.
FINER, HALF = 3, 20
#: Spans of a text that overlap by so many words belong to one passage.
TOGETHER = 25
#: Bytes of text whose shingles are hashed at a time.
CHUNK = 1 << 19
REACH = 255

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get(0, ())) < n:
        size = max(n, 2 * CHUNK)
        for slot, base in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[slot] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of texts one after the other, 0 where none starts, and each text's first place.

    Every text takes as many places as it has words, the last four of which start no shingle, so a zero divides any two.
    """
    joined = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    powers, inverse = _power_tables(len(joined))
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * powers[: len(joined)], out=sums[1:])
    word = ~_SPACE[joined]
    edge = np.diff(word.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = _mix((sums[ends] - sums[starts]) * inverse[starts])
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(starts, offsets)
    out = np.zeros(len(words), np.uint64)
    if len(words) >= WIDTH:
        total = np.zeros(len(words) - WIDTH + 1, np.uint64)
        for k in range(WIDTH):
            total = _mix(total + words[k : len(words) - WIDTH + 1 + k])
        out[: len(total)] = total | np.uint64(1)
    for k in range(1, WIDTH):
        out[np.maximum(first[1:] - k, first[:-1])[first[1:] > first[:-1]]] = 0
    return out, first


def compact_windows(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that are the minimum of some run of SHORTEST shingles, and how far their windows reach left and right.

    Zeros divide texts. Runs of minima over powers of two give both the openings and, by halving steps, the nearest
    smaller elements that bound a node's subtree; reaches are counted up to 255.
    """
    n = len(hashed)
    if n < SHORTEST:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    levels = [hashed]
    while 2 << (len(levels) - 1) <= min(n, REACH + 1):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))

    def slide(base: np.ndarray, op, width: int) -> np.ndarray:
        run, size = base, 1
        while size * 2 <= width:
            run, size = op(run[:-size], run[size:]), size * 2
        rest = width - size
        return op(run[: len(run) - rest], run[rest:]) if rest else run

    low = slide(hashed, np.minimum, SHORTEST)
    padded = np.concatenate([np.zeros(SHORTEST - 1, np.uint64), low, np.zeros(SHORTEST - 1, np.uint64)])
    top = slide(padded, np.maximum, SHORTEST)
    at = np.flatnonzero((top == hashed) & (hashed > 0))
    value = hashed[at]
    left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        size, table = 1 << j, levels[j]
        begin = at - left - size
        ok = begin >= 0
        ok[ok] = table[begin[ok]] > value[ok]
        left[ok] += size
        begin = at + right + 1
        ok = begin < len(table)
        ok[ok] = table[begin[ok]] >= value[ok]
        right[ok] += size
    wide = left + right + 1 >= SHORTEST  # of equal hashes the first is the minimum
    return at[wide], np.minimum(left[wide], REACH), np.minimum(right[wide], REACH)


def _meeting_keys(sh: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the minimum and its neighbours, and whether all of these are there."""
    inside = (at >= NEAR) & (at < len(sh) - NEAR)
    key = np.full(len(at), k + 1, np.uint64)
    for d in range(-NEAR, NEAR + 1):
        near = sh[np.clip(at + d, 0, len(sh) - 1)]
        inside &= near > 0
        key = _mix(key + near)
    return key, inside


def spaced(owner: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which windows to keep where one key comes again and again within less than a passage, as in a text that repeats a word.

    Of such a run the first, the last, and the first of each passage's length in between; all other windows.
    """
    order = np.lexsort((at, key, owner))
    o, k, a = owner[order], key[order], at[order]
    same = (o[1:] == o[:-1]) & (k[1:] == k[:-1]) & (a[1:] - a[:-1] < SHORTEST)
    first, last = np.r_[True, ~same][: len(a)], np.r_[~same, True][: len(a)]
    step = (a - a[first][np.cumsum(first) - 1]) // SHORTEST if len(a) else a
    return np.sort(order[first | last | np.r_[True, step[1:] != step[:-1]][: len(a)]])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(content, text) -> (content, key, place, left, right) of all windows."""

    def made(contents: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        sh, first = shingles(texts)
        for k in range(HASHES):
            at, left, right = compact_windows(np.where(sh > 0, _mix(sh + np.uint64(k * 0x51ED2701)) | np.uint64(1), np.uint64(0)))
            key, ok = _meeting_keys(sh, at, k)
            at, left, right, key = at[ok], left[ok], right[ok], key[ok]
            owner = np.searchsorted(first, at, side="right") - 1
            kept = spaced(owner, key, at)
            at, left, right, key, owner = at[kept], left[kept], right[kept], key[kept], owner[kept]
            yield pa.record_batch({
                "content": pa.array(np.array(contents, np.int64)[owner]), "key": pa.array(key.view(np.int64)), "place": pa.array((at - first[owner]).astype(np.int32)),
                "reach_left": pa.array(left.astype(np.int16)), "reach_right": pa.array(right.astype(np.int16)),
            })

    contents: list[int] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for content, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            contents.append(content)
            texts.append(raw)
            size += len(raw)
            if size >= CHUNK:
                yield from made(contents, texts)
                contents, texts, size = [], [], 0
    if texts:
        yield from made(contents, texts)


def _around(shingle_hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows of the shingles around each place, 0 where none is."""
    none = np.zeros(FAR, shingle_hashes.dtype)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([none, shingle_hashes, none]), 2 * FAR + 1)[place]


def word_edges(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end, in bytes."""
    word = ~_SPACE[np.frombuffer(raw, np.uint8)]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: How many stretches an excerpt spans: a window's own one, and of a hub, which meets others at any offset, two.
SPANS = (1, 2)


def _excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(content, text, asked (kind, stretch)) -> (content, kind, stretch, first, words): the words around a stretch, from word ``first`` on."""
    for batch in batches:
        for i in range(batch.num_rows):
            raw = batch.column(1)[i].as_py().encode("utf-8", "surrogatepass").lower()
            starts, ends = word_edges(raw)
            asked = batch.column(2)[i].values
            kinds, stretches = (np.asarray(asked.field(n), np.int64) for n in ("kind", "stretch"))
            for at in range(0, len(kinds), 1024):
                kind, stretch = kinds[at : at + 1024], stretches[at : at + 1024]
                first = np.clip(stretch * STRETCH - FAR, 0, len(starts) - 1)
                last = np.clip((stretch + np.take(SPANS, kind)) * STRETCH + FAR + WIDTH - 1, 1, len(starts)) - 1
                words = [raw[starts[f] : ends[max(f, e)]] for f, e in zip(first, last)]
                yield pa.record_batch({
                    "content": pa.array(np.full(len(kind), batch.column(0)[i].as_py(), np.int64)), "kind": pa.array(kind.astype(np.int32)),
                    "stretch": pa.array(stretch.astype(np.int32)), "first": pa.array(first.astype(np.int32)), "words": pa.array(words, pa.binary()),
                })


def finer_keys(sh: np.ndarray, place: np.ndarray) -> np.ndarray:
    """FINER min-hashes of the HALF shingles left, and as many right, of each place; 0 where there are fewer."""
    around = _around(sh, place)
    out = np.zeros((len(place), 2 * FINER), np.uint64)
    for side, part in enumerate((around[:, FAR - HALF : FAR], around[:, FAR + 1 : FAR + 1 + HALF])):
        whole = (part > 0).all(axis=1)
        for k in range(FINER):
            out[:, side * FINER + k] = np.where(whole, _mix(part + np.uint64((side * FINER + k + 1) * 0x632BE5AB)).min(axis=1), np.uint64(0))
    return out


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(content, text, windows (key, place, reach_left, reach_right)) -> the windows once for each finer key they have."""
    for batch in batches:
        for i in range(batch.num_rows):
            sh, _ = shingles([batch.column(1)[i].as_py().encode("utf-8", "surrogatepass")])
            every = batch.column(2)[i].values
            for start in range(0, len(every), 4096):
                some = every.slice(start, 4096)
                key, place, left, right = (np.asarray(some.field(n)) for n in ("key", "place", "reach_left", "reach_right"))
                finer = finer_keys(sh, place.astype(np.int64))
                for k in range(finer.shape[1]):
                    at = np.flatnonzero(finer[:, k])
                    yield pa.record_batch({
                        "content": pa.array(np.full(len(at), batch.column(0)[i].as_py(), np.int64)), "key": pa.array(_mix(finer[at, k] + key[at].view(np.uint64) + np.uint64(k)).view(np.int64)),
                        "place": pa.array(place[at]), "reach_left": pa.array(left[at]), "reach_right": pa.array(right[at]),
                    })


def agreeing_passages(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of aligned shingles, 0 where none is: (row, first, last) of each run of places where passages agree.

    A shingle agrees if the other side has it here or one place aside; SHORTEST shingles in a row are a passage if
    SIMILAR of them agree. Runs begin and end with a shingle that agrees.
    """
    same = (a == b) & (a > 0)
    same[:, 1:] |= (a[:, 1:] == b[:, :-1]) & (a[:, 1:] > 0)
    same[:, :-1] |= (a[:, :-1] == b[:, 1:]) & (a[:, :-1] > 0)
    sums = np.concatenate([np.zeros((len(a), 1), np.int32), np.cumsum(same, axis=1, dtype=np.int32)], axis=1)
    good = sums[:, SHORTEST:] - sums[:, :-SHORTEST] >= SIMILAR * SHORTEST
    edge = np.diff(good.astype(np.int8), axis=1, prepend=0, append=0)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] + SHORTEST - 2
    places = np.arange(same.shape[1])
    ahead = np.minimum.accumulate(np.where(same, places, same.shape[1])[:, ::-1], axis=1)[:, ::-1]
    behind = np.maximum.accumulate(np.where(same, places, -1), axis=1)
    return row, ahead[row, first], behind[row, last]


def aligned(excerpts: list[bytes], first: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """Rows of the shingles at places from ``begin`` on, of excerpts that start at word ``first``."""
    sh, at = shingles(excerpts)
    out = np.zeros((len(excerpts), width), np.uint64)
    for i, skip in enumerate((first - begin).tolist()):
        some = sh[at[i] + max(0, -skip) : at[i + 1]][: width - max(0, skip)]
        out[i, max(0, skip) : max(0, skip) + len(some)] = some
    return out


def _in_steps(row: np.ndarray, low: np.ndarray, high: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs longer than a step in pieces: where a text repeats itself at an offset, each time is a place of its own."""
    size = high - low + 1
    pieces = size // step + (size % step >= SHORTEST)
    pieces = np.where(size <= step, 1, pieces)
    at = np.repeat(np.arange(len(row)), pieces)
    begin = low[at] + (np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * step[at]
    return row[at], begin, np.minimum(high[at], begin + step[at] - 1)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (content, stretch, first, words, other, offset, other_first, other_words) -> (content, other, begin, end, other_begin, other_end) in words."""
    width = STRETCH + 2 * FAR
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            some = batch.slice(start, 512)
            number = lambda n: np.asarray(some.column(n), np.int64)  # noqa: B023, E731
            begin = number("stretch") * STRETCH - FAR
            offset = number("offset")
            a = aligned(some.column("words").to_pylist(), number("first"), begin, width)
            b = aligned(some.column("other_words").to_pylist(), number("other_first"), begin - offset, width)
            row, low, high = agreeing_passages(a, b)
            itself = np.asarray(some.column("content")) == np.asarray(some.column("other"))
            row, low, high = _in_steps(row, low, high, np.where(itself[row], np.abs(offset[row]), width))
            s, e = begin[row] + low, begin[row] + high + WIDTH
            yield pa.record_batch({
                "content": some.column("content").take(pa.array(row)), "other": some.column("other").take(pa.array(row)),
                "begin": pa.array(s), "end": pa.array(e), "other_begin": pa.array(np.maximum(s - offset[row], 0)), "other_end": pa.array(e - offset[row]),
            })


WINDOW = "content long, key long, place int, reach_left short, reach_right short"
PASSAGE = "content long, other long, begin long, end long, other_begin long, other_end long"


def _texts_with(read: DataFrame, lists: DataFrame) -> DataFrame:
    """(content, text, list) of the texts that a list (content, list) names, copies once."""
    asked = materialize(lists, "asked")
    some = join_checked(read, asked.select("content"), "content", "left_semi", rows=200_000)
    return some.groupBy("content").agg(F.first("text").alias("text")).join(asked, "content")


def _with_hubs(windows: DataFrame, label: str) -> DataFrame:
    """Windows whose key another has too, beside their key's first one, the hub (hub, at), without the hubs and their copies."""
    one = F.struct(F.col("content").alias("hub"), F.col("place").alias("at"), F.col("reach_left").alias("l"), F.col("reach_right").alias("r"))
    hubs = windows.groupBy("key").agg(F.min(one).alias("h"), F.max(one).alias("last")).filter("h <> last").select("key", "h.*")
    return materialize(windows.join(hubs, "key").filter("content <> hub or place <> at"), label)


def _compared(read: DataFrame, met: DataFrame) -> DataFrame:
    """Passages that windows share with their hubs.

    The interval join: windows that reach far enough around the hub's. All windows of two texts at one offset whose
    places lie in one stretch are one comparison. In one text the places must be a passage apart.
    """
    offset = F.col("place") - F.col("at")
    reach = F.least("reach_left", "l") + F.least("reach_right", "r") + 1 >= SHORTEST
    apart = (F.col("content") != F.col("hub")) | (F.abs(offset) >= SHORTEST)
    stretch = F.expr(f"cast(place div {STRETCH} as int)")
    pairs = met.filter(reach & apart).select("content", F.col("hub").alias("other"), offset.alias("offset"), stretch.alias("stretch")).distinct()
    beside = F.floor((F.col("stretch") * STRETCH - F.col("offset")) / STRETCH).cast("int")
    pairs = materialize(pairs.withColumn("other_stretch", beside), "pairs")
    asked = pairs.select("content", F.struct(F.lit(0).alias("kind"), "stretch").alias("a")).union(pairs.select("other", F.struct(F.lit(1), "other_stretch")))
    lists = asked.groupBy("content").agg(F.collect_set("a").alias("asked"))
    told = _texts_with(read, lists).select("content", "text", "asked").mapInArrow(lean(_excerpts), "content long, kind int, stretch int, first int, words binary")
    told = materialize(told, "excerpts", compression="zstd")
    own = told.filter("kind = 0").select("content", "stretch", "first", "words")
    other = told.filter("kind = 1").select(F.col("content").alias("other"), F.col("stretch").alias("other_stretch"), F.col("first").alias("other_first"), F.col("words").alias("other_words"))
    both = pairs.join(own, ["content", "stretch"]).join(other, ["other", "other_stretch"])
    both = both.select("content", "stretch", "first", "words", "other", "offset", "other_first", "other_words")
    return materialize(both.mapInArrow(lean(_compare), PASSAGE), "passages")


def repeated_passages(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered documents (row, doc_id, content), and links (content, other, begin, end, other_begin, other_end) between passages."""
    ensure_shipped(docs.sparkSession)
    rows = docs.select("doc_id", "text").withColumn("content", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    again = F.when(F.col("text").isNotNull(), F.xxhash64(F.lit(1), "text"))
    numbered = materialize(rows.select("doc_id", "content", again.alias("again")), "contents")
    # Texts are told apart by 128 bits: those that share the first 64 and not the others go by the others.
    clash = numbered.groupBy("content").agg(F.min("again").alias("a"), F.max("again").alias("b")).filter("a <> b").select("content", F.lit(True).alias("clash"))
    if clash.limit(1).count():
        clash = materialize(clash, "clashes")
        rows = join_checked(rows, clash, "content", "left").withColumn("content", F.when(F.col("clash"), again).otherwise(F.col("content"))).drop("clash")
        numbered = join_checked(numbered, clash, "content", "left").select("doc_id", F.when(F.col("clash"), F.col("again")).otherwise(F.col("content")).alias("content"))
    numbered = numbered.select("doc_id", "content")
    read = rows.filter(F.col("text").isNotNull()).select("content", "text")
    windows = materialize(read.mapInArrow(lean(_windows), WINDOW), "windows")
    met = _with_hubs(windows, "met")
    found = _compared(read, met)
    # Windows in no passage shared with their hub; of one text, those next to the hub are the hub's own passage.
    span = found.select(F.col("content").alias("_c"), F.col("other").alias("_o"), "begin", "end")
    inside = (F.col("content") == F.col("_c")) & (F.col("hub") == F.col("_o")) & F.col("place").between(F.col("begin"), F.col("end"))
    left = met.filter((F.col("content") != F.col("hub")) | (F.abs(F.col("place") - F.col("at")) >= SHORTEST)).join(span, inside, "left_anti")
    several = left.groupBy("key").agg(F.min(F.struct("content", "place")).alias("first"), F.max(F.struct("content", "place")).alias("last")).filter("first <> last").select("key")
    left = left.join(several, "key").select("content", "key", "place", "reach_left", "reach_right")
    lists = left.groupBy("content").agg(F.collect_set(F.struct("key", "place", "reach_left", "reach_right")).alias("windows"))
    finer = materialize(_texts_with(read, lists).select("content", "text", "windows").mapInArrow(lean(_finer), WINDOW), "finer")
    return numbered, found.union(_compared(read, _with_hubs(finer, "met_again")))


def merged_spans(spans: DataFrame, overlap: int = 0) -> DataFrame:
    """(content, spans): a text's spans joined that overlap by at least so many words; a text has a few windows per passage length."""
    listed = spans.groupBy("content").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("s"))
    empty = F.array().cast("array<struct<begin:bigint,end:bigint>>")

    def add(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last.getField("begin").alias("begin"), F.greatest(last.getField("end"), x.getField("end")).alias("end"))))
        return F.when((F.size(done) > 0) & (x.getField("begin") + overlap <= F.try_element_at(done, F.lit(-1)).getField("end")), joined).otherwise(F.concat(done, F.array(x)))

    return listed.select("content", F.aggregate("s", empty, add).alias("spans"))


def passage_groups(links: DataFrame) -> DataFrame:
    """(content, n_links, n_repeats) of the texts with passages.

    A text's spans that overlap by TOGETHER words are one place of a passage, and places that links connect are a group.
    A text links, once per group, with every other text of the group; its repeats are its further places there.
    """
    sides = links.select("content", "begin", "end").union(links.select("other", "other_begin", "other_end"))
    places = merged_spans(sides, TOGETHER).select("content", F.explode("spans").alias("s")).select("content", F.col("s.begin").alias("from"), F.col("s.end").alias("to"))
    places = materialize(places.withColumn("place", F.monotonically_increasing_id()), "places")
    edges = links.distinct()
    for side, content, begin, end in (("a", "content", "begin", "end"), ("b", "other", "other_begin", "other_end")):
        own = places.select(F.col("content").alias(content), "from", "to", F.col("place").alias(side))
        edges = edges.join(own, content).filter((F.col(begin) >= F.col("from")) & (F.col(end) <= F.col("to"))).drop("from", "to")
    roots = connected_components(edges.select("a", "b")).select(F.col("node").alias("place"), "root")
    held = places.join(roots, "place").groupBy("root", "content").agg(F.count(F.lit(1)).alias("n"))
    sizes = held.groupBy("root").agg(F.count(F.lit(1)).alias("texts"))
    return held.join(sizes, "root").groupBy("content").agg(F.sum(F.col("texts") - 1).alias("n_links"), F.sum(F.col("n") - 1).alias("n_repeats"))


def near_duplicate_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, copies, n_links, class_id, dup_words, spans, n_repeats): one row per document.

    ``copies`` are documents of exactly this text, ``n_links`` the other texts in the groups of its passages (a text that
    shares two passages with it counts twice), ``class_id`` the smallest doc_id reachable over copies and links,
    ``spans`` the word ranges ``begin:end`` (end exclusive) that repeat, ``n_repeats`` how often passages of it come
    again in itself.

    Defined cases: null texts link with nothing and are a class each by their own id; texts under 50 words have no
    passages, but copies of them share a class; repeated rows are copies; places of a text that repeat within less than
    a passage's length are no repeat; very long texts are read whole; a null doc_id never names a class that has
    another; an empty input gives an empty result. Other columns are ignored.
    """
    return settled(docs.sparkSession, "passages", lambda: _report(docs))


def _report(docs: DataFrame) -> DataFrame:
    numbered, links = repeated_passages(docs)
    links = materialize(links, "links")
    sides = links.select("content", "begin", "end").union(links.select("other", "other_begin", "other_end"))
    spans = merged_spans(sides)
    words = F.aggregate(F.transform("spans", lambda x: x.getField("end") - x.getField("begin")), F.lit(0).cast("long"), lambda a, b: a + b)
    spans = spans.select("content", "spans", words.alias("dup_words"))
    counts = passage_groups(links)
    roots = connected_components(links.filter("content <> other").select(F.col("content").alias("a"), F.col("other").alias("b")))
    texts = numbered.filter(F.col("content").isNotNull()).groupBy("content").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    member = texts.join(roots.withColumnRenamed("node", "content"), "content", "left")
    least = member.filter("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    told = member.join(least, "root", "left").select("content", "copies", F.coalesce("least", "first").alias("class_id"))
    told = told.join(counts, "content", "left").join(spans, "content", "left")
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x.getField("begin"), x.getField("end"))), ",")
    zero = F.lit(0).cast("long")
    of = lambda name: F.coalesce(name, zero).alias(name)
    told = told.select("content", "copies", of("n_links"), "class_id", of("dup_words"), F.coalesce(text, F.lit("")).alias("spans"), of("n_repeats"))
    found = numbered.join(told, "content").drop("content")
    alone = numbered.filter(F.col("content").isNull()).select("doc_id", F.lit(1).cast("long"), zero, F.col("doc_id"), zero, F.lit(""), zero)
    return found.union(alone)
