"""Connected components as DataFrame rounds, for links that are never gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """Roots of the nodes of an undirected graph: edges (a, b) -> (node, root), one row per node that has a link.

    Each round every node points to the best node among itself and its neighbours, and the graph is rewritten over
    the nodes pointed to; it shrinks until no link is left. "Best" is the smallest id, and in every other later round
    the smallest of a hash that changes with the round, which keeps long chains from taking many rounds. Minima
    combine before the shuffle, so a node with very many neighbours costs no more than others. The pointers of the
    rounds are then followed from first to last.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    left = materialize(edges.filter("a <> b").select(low, high).distinct(), "links")
    rounds: list[DataFrame] = []
    while left.limit(1).count():
        seed = F.lit(len(rounds))
        by_hash = len(rounds) > 1 and len(rounds) % 2 == 0

        def order(node: str, seed=seed, by_hash=by_hash):
            first = F.xxhash64(F.col(node), seed) if by_hash else F.lit(0).cast("long")
            return F.struct(first.alias("first"), F.col(node).alias("node"))

        both = left.select("a", "b").union(left.select("b", "a"))
        best = F.least(F.min(order("b")), F.min(order("a"))).alias("best")
        step = materialize(both.groupBy("a").agg(best).select(F.col("a").alias("node"), F.col("best.node").alias("to")), "step")
        rounds.append(step)
        of_a, of_b = (step.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab")
        moved = left.join(of_a, "a").join(of_b, "b").filter("to_a <> to_b")
        left = materialize(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0].select("node", F.col("to").alias("root"))
    for step in rounds[1:]:
        nxt = step.select(F.col("node").alias("root"), F.col("to").alias("_next"))
        found = found.join(nxt, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
    return materialize(found, "roots")
