"""Path abundances: non-negative least absolute deviations per species.

Find x >= 0 that minimises the weighted sum of |sum of x over the paths through a node - the node's depth|. The linear
dual has one row per path: maximise sum(d_v y_v) with |y_v| <= w_v and, for each path, the sum of y_v over its nodes <= 0.
A bounded-variable simplex keeps a basis of as many columns as there are paths, and its row prices are x. Nodes with the
same paths and depth are one column with their number as weight; that is summed in Spark before the species' groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.operators.cut import cut
from helixmill.operators.scan import dealt_by_size
from helixmill.shipping import ensure_shipped

EPS = 1e-9
#: Steps after which the inverse of the basis is computed anew.
REFRESH = 64
#: Cells of a species that one task takes; a larger species is fitted by refinement, and so many of all species need no dealing.
MOST_CELLS = 50_000


def lower_median(depth: np.ndarray, weight: np.ndarray) -> float:
    """The smallest depth that at least half of the weight doesn't exceed."""
    order = np.argsort(depth, kind="stable")
    return float(depth[order][np.searchsorted(np.cumsum(weight[order]), weight.sum() / 2)])


def path_blocks(incidence: np.ndarray) -> list[np.ndarray]:
    """Paths that share nodes, directly or over others, together."""
    shared = incidence.T.astype(float) @ incidence > 0
    root = np.arange(len(shared))
    for _ in root:
        new = np.array([root[near].min() if near.any() else i for i, near in enumerate(shared)], int)
        if (new == root).all():
            break
        root = new
    return [np.flatnonzero(root == r) for r in np.unique(root)]


def fit_paths(incidence: np.ndarray, depth: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """x for an incidence matrix (nodes by paths) of zeros and ones; 0 for a path without nodes."""
    return fit_with_gap(incidence, depth, weight)[0]


def fit_with_gap(incidence: np.ndarray, depth: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """x, and by how much its objective exceeds that of a feasible dual solution: 0 proves it optimal.

    Paths that share no node are fitted apart; a path of its own takes the lower median of its depths.
    """
    x, gap = np.zeros(incidence.shape[1]), 0.0
    for block in path_blocks(incidence):
        on = incidence[:, block].any(axis=1)
        a, d, w = incidence[np.ix_(on, block)], depth[on], weight[on]
        if not len(d):
            continue
        if len(block) == 1:
            x[block] = lower_median(d, w)
            continue
        x[block], dual = _simplex(a, d, w)
        feasible = (np.abs(dual) <= w + EPS).all() and (a.T @ dual <= EPS * w.sum()).all()
        gap += objective(a, d, w, x[block]) - float(d @ dual) if feasible else np.inf
    return x, gap


def _simplex(incidence: np.ndarray, depth: np.ndarray, weight: np.ndarray, steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """x and the dual solution; raises if the steps don't come to an end."""
    n, p = incidence.shape
    columns = np.hstack([incidence.T.astype(float), np.eye(p)])
    gain = np.concatenate([depth, np.zeros(p)])
    low, high = np.concatenate([-weight, np.zeros(p)]), np.concatenate([weight, np.full(p, np.inf)])
    at_high = np.zeros(n + p, bool)
    basis = np.arange(n, n + p)
    value = low.copy()
    value[basis] = incidence.T.astype(float) @ weight
    stalled = 0
    steps = 50 * (n + p) + 100 if steps is None else steps
    inverse = np.eye(p)
    for done in range(steps):
        if done % REFRESH == REFRESH - 1:
            inverse = np.linalg.inv(columns[:, basis])
        price = gain[basis] @ inverse
        reduced = gain - price @ columns
        reduced[basis] = 0
        wish = np.where(at_high, -reduced, reduced)
        wish[basis] = 0
        # The largest reduced cost enters; after steps that don't move, the first one, so that the method ends.
        enter = int(np.argmax(wish > EPS)) if stalled > p + 5 else int(np.argmax(wish))
        if wish[enter] <= EPS:
            if done and done % REFRESH != REFRESH - 1:  # confirmed with an inverse of its own
                inverse = np.linalg.inv(columns[:, basis])
                value[basis] = inverse @ -(np.delete(columns, basis, axis=1) @ np.delete(value, basis))
                price = gain[basis] @ inverse
                reduced = gain - price @ columns
                reduced[basis] = 0
                if np.where(at_high, -reduced, reduced).max() > EPS:
                    continue
            return np.maximum(price, 0), value[:n]
        sign = -1.0 if at_high[enter] else 1.0
        turned = inverse @ columns[:, enter]
        change = -sign * turned
        room = np.full(p, np.inf)
        up, down = change > EPS, change < -EPS
        room[up] = (high[basis][up] - value[basis][up]) / change[up]
        room[down] = (low[basis][down] - value[basis][down]) / change[down]
        room = np.maximum(room, 0)
        leave = int(np.argmin(room))
        step = min(room[leave], high[enter] - low[enter])
        stalled = stalled + 1 if step <= EPS else 0
        value[enter] += sign * step
        value[basis] += change * step
        if room[leave] >= high[enter] - low[enter]:
            at_high[enter] = ~at_high[enter]
            value[enter] = high[enter] if at_high[enter] else low[enter]
            continue
        out = basis[leave]
        at_high[out] = change[leave] > 0
        value[out] = high[out] if at_high[out] else low[out]
        basis[leave] = enter
        at_high[enter] = False
        pivot = inverse[leave] / turned[leave]
        inverse -= np.outer(turned, pivot)
        inverse[leave] = pivot
    raise RuntimeError(f"no optimum within {steps} steps for {p} paths over {n} kinds of nodes")


def objective(incidence: np.ndarray, depth: np.ndarray, weight: np.ndarray, x: np.ndarray) -> float:
    return float(weight @ np.abs(incidence @ x - depth))


FITTED = "species string, hap_id string, x double, objective double, gap double"


def incidence_of(sets) -> tuple[list[str], np.ndarray]:
    """The paths named in lists of paths, in order, and the matrix of zeros and ones of lists by paths."""
    names = sorted({h for haps in sets for h in haps})
    at = {h: i for i, h in enumerate(names)}
    matrix = np.zeros((len(sets), len(names)))
    for row, haps in enumerate(sets):
        matrix[row, [at[h] for h in haps]] = 1
    return names, matrix


def path_cells(walks: DataFrame, depth: DataFrame) -> DataFrame:
    """(species, haps, depth, n): how many nodes of a depth lie on just these paths."""
    sets = walks.select("species", "node_id", "hap_id").distinct().groupBy("species", "node_id").agg(F.array_sort(F.collect_set("hap_id")).alias("haps"))
    used = sets.join(depth.filter("depth > 0").select("species", "node_id", "depth"), ["species", "node_id"])
    return used.groupBy("species", "haps", "depth").agg(F.count(F.lit(1)).alias("n"))


def _solved(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.assign(_key=[",".join(h) for h in frame.haps]).sort_values(["_key", "depth"])
    names, matrix = incidence_of(list(frame.haps))
    d, w = frame.depth.to_numpy(float), frame.n.to_numpy(float)
    x, gap = fit_with_gap(matrix, d, w)
    return pd.DataFrame({"species": frame.species.iloc[0], "hap_id": names, "x": x, "objective": objective(matrix, d, w, x) / w.sum(), "gap": gap / w.sum()})


def _one_after_another(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by species -> the fits, a species at a time."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        for _, part in frame.groupby("species", sort=False):
            if held and held[-1].species.iloc[0] != part.species.iloc[0]:
                yield _solved(pd.concat(held))
                held = []
            held.append(part)
    if held:
        yield _solved(pd.concat(held))


def fit_species(walks: DataFrame, depth: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """(species, hap_id, x, objective, gap): walks (species, hap_id, node_id) and depths (species, node_id, depth).

    Only nodes with depth on some walk count; the objective is their mean absolute deviation, and ``gap`` what a dual
    solution proves it may exceed the optimum by. A species with many reads is no larger here than its distinct sets of
    paths and depths. Species are dealt to tasks by their number of these cells, the largest first; one of more than
    ``most_cells`` is fitted by refinement, with its cells spread over all tasks.
    """
    spark = walks.sparkSession
    ensure_shipped(spark)
    cells = cut(path_cells(walks, depth))
    sizes = cut(cells.groupBy("species").agg(F.count(F.lit(1)).alias("cells")))
    most, every = sizes.agg(F.max("cells"), F.sum("cells")).first()
    if (every or 0) <= most_cells:
        return cells.groupBy("species").applyInPandas(_solved, FITTED)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(dealt_by_size(sizes.filter(F.col("cells") <= most_cells), "species", "cells", tasks))
    fits = cells.join(dealt, "species").repartitionById(tasks, "task").sortWithinPartitions("species").drop("task").mapInPandas(_one_after_another, FITTED)
    if most > most_cells:
        from helixmill.operators.refine import fit_large

        fits = fits.union(fit_large(cells.join(sizes.filter(F.col("cells") > most_cells), "species", "left_semi")))
    return fits


def single_path(walks: DataFrame, depth: DataFrame) -> DataFrame:
    """(species, hap_id, first_sol) as if each path were alone: the lower median of its nodes' positive depths."""
    on = walks.select("species", "hap_id", "node_id").distinct().join(depth.filter("depth > 0"), ["species", "node_id"])
    return on.groupBy("species", "hap_id").agg(F.expr("percentile_disc(0.5) within group (order by depth)").alias("first_sol"))
