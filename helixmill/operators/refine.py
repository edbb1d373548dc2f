"""Path abundances of species whose cells don't fit a task: columns are generated where the fit asks for them.

The nodes on one set of paths contribute a convex function of the sum u of these paths' abundances. Their depths are cut
into intervals, and an interval stands for its nodes with their number and mean depth: that is never more than what they
contribute, and exactly that unless u lies inside the interval. A small master problem per species is solved over the
intervals; Spark sums their nodes. Where u falls inside an interval, it is cut there and the problem is solved again.
When no u does, the master's optimum is the species' own. In the dual, an interval is a bundle of columns with one value,
and a cut prices them apart.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.operators.cut import cut
from helixmill.operators.lad import fit_with_gap, incidence_of, objective

#: Shares of a set's nodes between which its first intervals are cut.
FIRST = [k / 16 for k in range(1, 16)]
#: Cut lists up to this many are broadcast.
BROADCAST_SETS = 100_000
INSIDE = 1e-9
MASTER = "species string, haps array<string>, hap_id string, value double, open boolean, objective double, gap double"


def master(frame: pd.DataFrame) -> pd.DataFrame:
    """Intervals of one species (haps, weight, depth, low, high) -> for each set of paths u and whether it lies inside an interval; for each path x."""
    frame = frame.assign(_key=[",".join(h) for h in frame.haps]).sort_values(["_key", "low"])
    names, matrix = incidence_of(list(frame.haps))
    d, w = frame.depth.to_numpy(float), frame.weight.to_numpy(float)
    x, gap = fit_with_gap(matrix, d, w)
    u = matrix @ x
    near = INSIDE * (1 + abs(u))
    frame = frame.assign(value=u, open=(frame.low < u - near) & (u + near < frame.high))
    sets = frame.groupby("_key", sort=False).agg(haps=("haps", "first"), value=("value", "first"), open=("open", "max")).assign(hap_id=None)
    paths = pd.DataFrame({"haps": [None] * len(names), "hap_id": names, "value": x, "open": False})
    told = {"species": frame.species.iloc[0], "objective": objective(matrix, d, w, x) / w.sum(), "gap": gap / w.sum()}
    return pd.concat([sets, paths]).assign(**told)[["species", "haps", "hap_id", "value", "open", "objective", "gap"]]


def intervals(cells: DataFrame, cuts: DataFrame) -> DataFrame:
    """(species, haps, part, weight, depth, low, high) of cells (species, haps, depth, n) between the cuts (species, haps, cuts)."""
    few = cuts.limit(BROADCAST_SETS + 1).count() <= BROADCAST_SETS
    placed = cells.join(F.broadcast(cuts) if few else cuts, ["species", "haps"])
    part = F.size(F.filter("cuts", lambda c: c < F.col("depth")))
    sums = placed.groupBy("species", "haps", part.alias("part")).agg(
        F.sum("n").alias("weight"), F.sum(F.col("n") * F.col("depth")).alias("_sum"), F.min("depth").alias("low"), F.max("depth").alias("high"))
    mean = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("_sum") / F.col("weight"))
    return sums.select("species", "haps", "part", "weight", mean.alias("depth"), "low", "high")


def fit_large(cells: DataFrame, rounds: int = 200) -> DataFrame:
    """(species, hap_id, x, objective, gap) of cells (species, haps, depth, n); a task holds a species' intervals and never its cells."""
    first = F.array_sort(F.array_distinct(F.percentile_approx("depth", FIRST, F.lit(1000))))
    cuts = cut(cells.groupBy("species", "haps").agg(first.alias("cuts")))
    done: DataFrame | None = None
    for _ in range(rounds):
        told = cut(intervals(cells, cuts).groupBy("species").applyInPandas(master, MASTER))
        left = cut(told.filter("open").select("species").distinct())
        ready = told.join(left, "species", "left_anti").filter("hap_id is not null")
        done = ready if done is None else done.union(ready)
        if not left.limit(1).count():
            return done.select("species", "hap_id", F.col("value").alias("x"), "objective", "gap")
        more = told.filter("open").select("species", "haps", F.array("value").alias("_more"))
        cuts = cuts.join(left, "species", "left_semi").join(more, ["species", "haps"], "left")
        every = F.array_sort(F.array_distinct(F.concat("cuts", F.coalesce("_more", F.array().cast("array<double>")))))
        cuts = cut(cuts.select("species", "haps", every.alias("cuts")))
        cells = cells.join(left, "species", "left_semi")
    raise RuntimeError(f"no optimum within {rounds} rounds")
