"""Suffix sorting by linear grouping construction.

First all suffixes are grouped by their first symbol. Groups are then taken in descending order; for
each member the nearest earlier suffix of a lower group (its previous-smaller pointer) is found, and
the suffixes so pointed to are split off to the upper end of their groups by the number of members that
point to them. When all are done, suffixes share a group exactly when they share their Lyndon prefix.
Then one pass in ascending order emits each group's suffixes: what an already placed suffix's
predecessors point to is next in its group. No text is renamed and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The start positions of text's suffixes in ascending order; the end counts as lower than any symbol."""
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    first = np.argsort(text, kind="stable")
    ordered = np.asarray(text)[first]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.concatenate([heads, [n]]))
    group = np.empty(n, dtype=np.int64)  # where the suffix's group begins among the sorted suffixes
    group[first] = np.repeat(heads, sizes)
    place = np.empty(n, dtype=np.int64)
    place[first] = np.arange(n)
    size = np.zeros(n, dtype=np.int64)
    size[heads] = sizes
    return np.array(_emitted(*_grouped(first.tolist(), group.tolist(), place.tolist(), size.tolist())), dtype=np.int64)


def _grouped(held: list[int], group: list[int], place: list[int], size: list[int]) -> tuple[list[int], list[int]]:
    """Group starts by Lyndon prefix, and previous-smaller pointers."""
    smaller = [-1] * len(held)
    end = len(held)
    while end:
        start = group[held[end - 1]]
        pointed: dict[int, int] = {}
        for i in held[start:end] if end - start == 1 else sorted(held[start:end]):
            j = i - 1
            while j >= 0:
                g = group[j]
                if g < start:
                    break
                j = smaller[j]
                if g == start:
                    break
            smaller[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        end = start
        if not pointed:
            continue
        by_count: dict[int, list[int]] = {}
        for j, times in pointed.items():
            by_count.setdefault(times, []).append(j)
        for times in sorted(by_count, reverse=True) if len(by_count) > 1 else by_count:
            moved = by_count[times]
            for j in moved:
                g = group[j]
                left = size[g] = size[g] - 1
                at, last = place[j], g + left
                if at != last:
                    other = held[last]
                    held[at], held[last] = other, j
                    place[other], place[j] = at, last
            for j in moved:
                new = group[j] + size[group[j]]
                group[j] = ~new  # marked, so that sizes stay as they are until all are known
            for j in moved:
                new = group[j] = ~group[j]
                size[new] += 1
    return group, smaller


def _emitted(group: list[int], smaller: list[int]) -> list[int]:
    n = len(group)
    free = list(range(n))  # the next free place of the group that begins here
    placed = bytearray(n)
    out = [0] * n
    j, i = n - 1, -1
    while True:
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = smaller[j]
        i += 1
        if i == n:
            return out
        j = out[i] - 1
