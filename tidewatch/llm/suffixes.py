"""Suffix arrays by linear grouping: Lyndon-prefix groups in descending order, then each group's order.

Phase one begins with suffixes grouped by first symbol. Groups are taken from the last to the first; each suffix in the group
points to the previous suffix that is in a smaller group, and the suffixes pointed to move to a new group right behind their
own, which now stands for their prefix with the group's prefix appended. When all groups have been taken, a group holds the
suffixes with one Lyndon prefix. Phase two walks over the array from the front and puts what points to each entry at the front
of its group; symbols are never renamed and nothing is sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> list[int]:
    """The start of each suffix, in order; a suffix that is a prefix of another comes first. Symbols are whole numbers."""
    n = len(symbols)
    if n < 2:
        return list(range(n))
    order = np.argsort(symbols, kind="stable")
    first = np.flatnonzero(np.diff(symbols[order], prepend=symbols[order[0]] - 1))
    sizes = np.diff(np.append(first, n))
    array: list[int] = order.tolist()  # members of each group stand together
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    place = place.tolist()
    start = np.empty(n, np.int64)  # of each suffix: where its group begins
    start[order] = np.repeat(first, sizes)
    start = start.tolist()
    size = [0] * n  # of the group that begins there
    for a, b in zip(first.tolist(), sizes.tolist(), strict=True):
        size[a] = b
    return emit(n, array, place, start, *group(n, array, place, start, size))


def group(n: int, array: list[int], place: list[int], start: list[int], size: list[int]) -> tuple[list[int], list[int]]:
    """Phase one. Returns previous pointers and the final group starts."""
    previous = [-1] * n
    done = [False] * n
    final = [0] * n
    end = n
    while end:
        begin = start[array[end - 1]]
        members = array[begin:end]
        for s in members:
            final[s] = begin
            done[s] = True
        # previous suffix in a smaller group: pointers of suffixes of larger groups are followed
        towards: dict[int, int] = {}
        members.sort()
        for s in members:
            p = s - 1
            while p >= 0 and done[p]:
                if final[p] < begin:
                    break
                p = previous[p] if final[p] > begin or previous[p] >= 0 else -1
            previous[s] = p
            if p >= 0:
                towards[p] = towards.get(p, 0) + 1
        if towards:
            most = max(towards.values())
            for times in range(most, 0, -1):
                moving = [p for p, c in towards.items() if c == times] if most > 1 else list(towards)
                split(moving, array, place, start, size)
        end = begin
    return previous, final


def split(moving: list[int], array: list[int], place: list[int], start: list[int], size: list[int]) -> None:
    """Moves suffixes to new groups right behind what stays of their own."""
    taken: dict[int, int] = {}
    for p in moving:
        g = start[p]
        c = taken.get(g, 0) + 1
        taken[g] = c
        to = g + size[g] - c
        at = place[p]
        other = array[to]
        array[to], array[at] = p, other
        place[p], place[other] = to, at
    for g, c in taken.items():
        if c < size[g]:
            stay = size[g] - c
            size[g] = stay
            new = g + stay
            size[new] = c
            for i in range(new, new + c):
                start[array[i]] = new


def emit(n: int, array: list[int], place: list[int], start: list[int], previous: list[int], final: list[int]) -> list[int]:
    """Phase two."""
    out = [-1] * n
    front = {}
    placed = [False] * n
    # the suffix before the end of the text, and what it continues, come first in their groups
    s = n - 1
    while s >= 0:
        g = final[s]
        out[g + front.get(g, 0)] = s
        front[g] = front.get(g, 0) + 1
        placed[s] = True
        s = previous[s]
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = final[s]
            f = front.get(g, 0)
            out[g + f] = s
            front[g] = f + 1
            placed[s] = True
            s = previous[s]
    return out


def common_prefixes(symbols: list[int], array: list[int]) -> list[int]:
    """Of each suffix in the array and the one before it: how many first symbols they share."""
    n = len(array)
    rank = [0] * n
    for i, s in enumerate(array):
        rank[s] = i
    out, h = [0] * n, 0
    for s in range(n):
        r = rank[s]
        if r:
            j = array[r - 1]
            while s + h < n and j + h < n and symbols[s + h] == symbols[j + h]:
                h += 1
            out[r] = h
            h = h - 1 if h else 0
        else:
            h = 0
    return out
