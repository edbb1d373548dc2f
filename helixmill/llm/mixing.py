"""Mixing sources to target weights by entropy balancing.

Every source has one moment constraint: the words its documents contribute equal the source's target. Among all
document rates between 0 and ``cap`` that meet the constraints, entropy balancing takes those closest in relative
entropy to "each document once"; its convex dual has one multiplier per source, and the rates are the exponential
tilts ``min(cap, exp(multiplier * size / mean size))``. A safeguarded Newton iteration solves the dual. Each step is
one aggregation of the (source, size) histogram, all sums are exact decimals, so that reruns agree to the bit.

Rates become whole copies by systematic rounding: inside a source documents are ordered by size class, and running sums
of the rates in fixed point decide where a copy falls, so the words a source takes stay within about one document of
the target. Size classes with many documents are split into blocks that round by themselves. A few documents per source
then gain or lose a copy to close the rest of the gap.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import global_rank, join_checked, materialize, settled, union_all, word_count

#: Rates are held as multiples of 2**-30.
UNIT_BITS = 30
UNIT = 1 << UNIT_BITS


def source_targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Add ``weight`` and ``target`` to one row per source (source, source_size, ...).

    Sources by code point, null last, take the weights in turn. They share all words by weight; a source stops at
    ``cap`` times its size and the excess is shared again until none is above.
    """
    ranked = global_rank(sources, [F.col("source").asc_nulls_last()], "sid")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight), "sources")
    most = F.col("source_size").cast("double") * cap
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = most <= F.col("weight") * F.lit(level)
        filled, free = ranked.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
        new = (total - (filled or 0.0)) / free if free else level
        if new <= level:
            break
        level = new
    return ranked.withColumn("target", F.least(most, F.col("weight") * F.lit(level)))


def _rate(cap: int):
    tilt = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(math.log(cap) + 1)))
    return F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), tilt))


def solve_tilts(hist: DataFrame, sources: DataFrame, cap: int, tolerance: float, max_steps: int) -> DataFrame:
    """Multiplier of each source: hist (sid, size, n) over positive sizes; sources (sid, target, source_size, ...)."""
    shape = hist.groupBy("sid").agg(F.sum("n").alias("n_sized"), F.min("size").alias("least"))
    open_ = F.col("target") < F.col("source_size") * F.lit(cap * (1 - 1e-12))
    state = (
        sources.join(shape, "sid")
        .select("sid", "target", "source_size", (F.col("source_size") / F.col("n_sized")).alias("mean"), "least", (~open_).alias("full"))
        .withColumn("lo", F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size"))) * F.col("mean") / F.col("least"))
        .withColumn("hi", F.lit(math.log(cap)) * F.col("mean") / F.col("least"))
        .withColumn("lam", F.lit(0.0))
        .withColumn("done", F.col("full"))
    )
    state = materialize(state, "tilts")
    for _ in range(max_steps):
        if not state.filter(~F.col("done")).limit(1).count():
            break
        # One dual step: gradient and curvature per source, in exact decimal sums.
        rows = join_checked(hist, state.filter(~F.col("done")).select("sid", "lam", "mean", "full"), "sid")
        rate = _rate(cap)
        words = (F.col("n") * F.col("size")).cast("decimal(20,0)")
        curve = F.when(rate < cap, rate * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = rows.groupBy("sid").agg(
            F.sum(words * F.round(rate * UNIT).cast("decimal(11,0)")).alias("_grad"),
            F.sum(words * F.round(curve * UNIT).cast("decimal(18,0)")).alias("_curve"),
        )
        miss = F.col("_grad").cast("double") / UNIT - F.col("target")
        step = (
            state.join(sums, "sid", "left")
            .withColumn("_miss", miss)
            .withColumn("_lo", F.when(F.col("_miss") < 0, F.col("lam")).otherwise(F.col("lo")))
            .withColumn("_hi", F.when(F.col("_miss") > 0, F.col("lam")).otherwise(F.col("hi")))
            .withColumn("_newton", F.col("lam") - F.try_divide(F.col("_miss"), F.col("_curve").cast("double") / UNIT))
            .withColumn("_inside", (F.col("_newton") > F.col("_lo")) & (F.col("_newton") < F.col("_hi")))
            .withColumn("_ok", F.abs("_miss") <= F.lit(0.5) + F.col("target") * tolerance)
        )
        moved = F.when(F.col("_inside"), F.col("_newton")).otherwise((F.col("_lo") + F.col("_hi")) / 2)
        state = materialize(
            step.select(
                "sid", "target", "source_size", "mean", "least", "full",
                F.when(F.col("done"), F.col("lo")).otherwise(F.col("_lo")).alias("lo"),
                F.when(F.col("done"), F.col("hi")).otherwise(F.col("_hi")).alias("hi"),
                F.when(F.col("done") | F.col("_ok"), F.col("lam")).otherwise(moved).alias("lam"),
                (F.col("done") | F.coalesce(F.col("_ok"), F.lit(False))).alias("done"),
            ),
            "tilts",
        )
    else:
        if missed := state.filter(~F.col("done")).count():
            warnings.warn(f"{missed} sources miss their targets after {max_steps} Newton steps", stacklevel=2)
    return state


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    cap: int = 3,
    block: int = 256,
    tolerance: float = 1e-7,
    max_steps: int = 80,
    repairs: int = 6,
    near: float = 0.001,
) -> DataFrame:
    """Copies of every document that bring each source's words to its target.

    Takes (doc_id, source, size) and, if a caller needs a key of its own, ``row``. Returns these with ``source_size``,
    ``target``, ``rate`` and ``copies`` (0 to ``cap``).

    Defined cases: a null size counts as 0; a source without words has target 0; documents without words get no copy;
    a null source is a source of its own; ties and repeated rows are rounded one after the other; an empty input gives
    an empty result. Other columns are ignored, so that their names can't clash.
    """
    return settled(docs.sparkSession, "mixed", lambda: _mixed(docs, weights, cap, block, tolerance, max_steps, repairs, near))


def _mixed(docs: DataFrame, weights: tuple[int, ...], cap: int, block: int, tolerance: float, max_steps: int, repairs: int, near: float) -> DataFrame:
    size_class = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * 8)).otherwise(-1).cast("int")
    key = ["row"] if "row" in docs.columns else []
    docs = docs.select(*key, "doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"))
    raw = materialize(docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    sources = materialize(
        source_targets(raw.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, cap), "targets"
    )
    named = sources.select(F.col("source").alias("_source"), "sid")
    hist = materialize(
        join_checked(raw, named, F.col("source").eqNullSafe(F.col("_source"))).select("sid", "size", "n", size_class.alias("_class")), "hist"
    )
    tilts = solve_tilts(hist.filter("size > 0"), sources, cap, tolerance, max_steps)

    keep = sources.join(tilts.select("sid", "mean", "lam", "full"), "sid", "left").select(
        "sid", F.col("source").alias("_source"), "source_size", "target", "mean", "lam", "full"
    )
    keep = materialize(keep, "rates")
    units = F.when(F.col("size") > 0, F.round(_rate(cap) * UNIT).cast("long")).otherwise(F.lit(0)).cast("long")
    rated = join_checked(hist, keep, "sid").withColumn("_units", units)
    share = F.pmod(F.pmod(F.col("n"), F.lit(UNIT)) * F.col("_units"), F.lit(UNIT))
    cells = rated.groupBy("sid", "_class").agg(F.sum("n").alias("_n"), F.sum(share).alias("_sum"))
    before = Window.partitionBy("sid").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "sid", "_class",
        F.ceil(F.col("_n") / block).cast("long").alias("_blocks"),
        F.pmod(F.coalesce(F.sum("_sum").over(before), F.lit(0)), F.lit(UNIT)).alias("_start"),
    )
    cells = materialize(join_checked(cells, keep, "sid").withColumnRenamed("_class", "_cell_class"), "cells")

    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_class") == F.col("_cell_class"))
    placed = join_checked(docs.withColumn("_class", size_class), cells, same).withColumn("_block", F.pmod(F.xxhash64("doc_id"), F.col("_blocks")))
    placed = placed.withColumn("rate", F.when(F.col("size") > 0, _rate(cap)).otherwise(0.0)).withColumn("_units", units)
    placed = placed.repartition("sid", "_class", "_block")
    inner = Window.partitionBy("sid", "_class", "_block").orderBy("size", F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(F.col("_block") == 0, F.col("_start")).otherwise(F.pmod(F.xxhash64("sid", "_class", "_block"), F.lit(UNIT)))
    placed = placed.withColumn("_upto", F.sum("_units").over(inner) + start)
    copies = F.shiftright(F.col("_upto"), UNIT_BITS) - F.shiftright(F.col("_upto") - F.col("_units"), UNIT_BITS)
    rounded = placed.select(*docs.columns, "sid", "source_size", "target", "rate", copies.cast("long").alias("copies"))
    return _repaired(rounded, cap, repairs, near).drop("sid")


def _repaired(rounded: DataFrame, cap: int, repairs: int, near: float) -> DataFrame:
    """Close what rounding left: per pass and source, the largest document that fits into the gap gains or loses a copy.

    Passes read one candidate of each source and size; a source within ``near`` of its target is left alone.
    """
    rounded = materialize(rounded.withColumn("_id", F.monotonically_increasing_id()), "copies")
    one = F.struct(F.xxhash64("doc_id").alias("h"), "_id")
    spare = [F.max(F.when(F.col("copies") < cap, one)).alias("up"), F.max(F.when(F.col("copies") > 0, one)).alias("down")]
    candidates = materialize(rounded.filter("size > 0").groupBy("sid", "size").agg(*spare), "candidates")
    is_open = (F.abs("gap") >= 1) & (F.abs("gap") > near * F.col("goal"))
    gaps = rounded.groupBy("sid").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"), F.max("target").alias("goal"))
    gaps = materialize(gaps.filter(is_open).withColumn("below", F.lit(None).cast("long")), "gaps")
    changes: list[DataFrame] = []
    for _ in range(repairs):
        fits = join_checked(candidates, gaps, "sid").filter((F.col("size") <= F.abs("gap")) & (F.col("below").isNull() | (F.col("size") < F.col("below"))))
        chosen = F.when(F.col("gap") > 0, F.col("up._id")).otherwise(F.col("down._id"))
        fits = fits.withColumn("_id", chosen).filter("_id is not null")
        best = fits.groupBy("sid").agg(F.max(F.struct("size", "_id", F.signum("gap").cast("long").alias("s"))).alias("b"))
        found = materialize(best.select("sid", F.col("b.size").alias("size"), F.col("b._id").alias("_id"), F.col("b.s").alias("_delta")), "changes")
        if not found.limit(1).count():
            break
        changes.append(found.select("_id", "_delta"))
        left = gaps.join(found, "sid").select("sid", (F.col("gap") - F.col("_delta") * F.col("size")).alias("gap"), "goal", F.col("size").alias("below"))
        gaps = materialize(left.filter(is_open), "gaps")
    if not changes:
        return rounded.drop("_id")
    done = join_checked(rounded, union_all(changes), "_id", "left")
    return done.withColumn("copies", (F.col("copies") + F.coalesce("_delta", F.lit(0))).cast("long")).drop("_id", "_delta")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``mix_sources`` over documents (doc_id, text, source, ...); sizes are words of the whole text."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return settled(docs.sparkSession, "mixed", lambda: mix_sources(materialize(sized, "sized"), **options))
