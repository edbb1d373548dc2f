"""Largest cliques by branch and bound: sets are bits of integers, a colouring of what is left bounds how far it can reach."""

from __future__ import annotations


def _members(bits: int) -> list[int]:
    out = []
    while bits:
        low = bits & -bits
        out.append(low.bit_length() - 1)
        bits ^= low
    return out


def _coloured(near: list[int], left: int) -> list[tuple[int, int]]:
    """(vertex, colours used up to it) of all vertices left, greedily coloured: no clique among those up to a vertex exceeds its colours."""
    out, colour = [], 0
    while left:
        colour += 1
        free = left
        while free:
            low = free & -free
            v = low.bit_length() - 1
            free &= ~near[v] & ~low
            left ^= low
            out.append((v, colour))
    return out


def largest(near: list[int], left: int, beyond: int = 0, enough: int | None = None) -> list[int]:
    """A largest clique among the vertices ``left`` if it has more than ``beyond``, else none; the first of ``enough`` members ends the search."""
    best: list[int] = []
    stack = [([], left, _coloured(near, left))]
    while stack:
        clique, open_, order = stack[-1]
        if not order:
            stack.pop()
            continue
        v, colours = order.pop()
        if len(clique) + colours <= max(len(best), beyond):
            stack.pop()
            continue
        stack[-1] = (clique, open_ & ~(1 << v), order)
        inside = open_ & near[v]
        if len(clique) + 1 > max(len(best), beyond):
            best = [*clique, v]
            if enough is not None and len(best) >= enough:
                return best
        if inside:
            stack.append(([*clique, v], inside, _coloured(near, inside)))
    return best


def first_largest(near: list[int], left: int, beyond: int = 0) -> list[int]:
    """Of the largest cliques (of more than ``beyond``) the one whose members in order come first; vertices are numbered in that order."""
    size = len(largest(near, left, beyond))
    chosen: list[int] = []
    while len(chosen) < size:
        for v in _members(left):
            rest = near[v] & left & ~((1 << (v + 1)) - 1)
            need = size - len(chosen) - 1
            if not need or len(largest(near, rest, need - 1, need)) >= need:
                chosen.append(v)
                left = rest
                break
    return chosen


def best_cliques(edges: list[tuple], vertices: list, wanted: set) -> list[list]:
    """The first largest clique of a graph, and the first largest of those that hold a vertex of ``wanted``, if it has any there."""
    names = sorted(vertices)
    at = {v: i for i, v in enumerate(names)}
    near = [0] * len(names)
    for a, b in edges:
        near[at[a]] |= 1 << at[b]
        near[at[b]] |= 1 << at[a]
    whole = first_largest(near, (1 << len(names)) - 1)
    found = [[names[i] for i in whole]] if whole else []
    with_one: list[int] = []
    for v in sorted(at[w] for w in wanted if w in at):
        rest = first_largest(near, near[v], max(len(with_one) - 2, 0)) if near[v] else []
        own = sorted([v, *rest])
        if (len(own), [-i for i in own]) > (len(with_one), [-i for i in with_one]):
            with_one = own
    if with_one:
        found.append([names[i] for i in with_one])
    return found
