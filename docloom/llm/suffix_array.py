"""Suffix arrays by linear grouping.

Suffixes are first grouped by their Lyndon prefix. Groups are taken in descending order; each suffix of a group points to the
nearest suffix before it that is in a smaller group, and the suffixes pointed to move up, just above their old group,
the further the more pointers reach them. Then the order within groups is emitted front to back: a placed suffix
places the one before it and that one's chain of pointers. No names are ever recomputed.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Suffix array of ``text`` (integers from 0), a shorter suffix before its extensions."""
    n = len(text)
    if not n:
        return []
    members: list[list[int]] = []
    owner = [0] * n
    names: dict[int, int] = {}
    for symbol in sorted(set(text)):
        names[symbol] = len(members)
        members.append([])
    for i, symbol in enumerate(text):
        owner[i] = g = names[symbol]
        members[g].append(i)
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]

    smaller = [-1] * n  # the pointers
    jump = list(range(n))  # to itself while a suffix is not taken, then towards the next such one before it
    group = len(members) - 1
    while group >= 0:
        own = [i for i in members[group] if owner[i] == group]
        members[group] = own
        for i in own:
            jump[i] = i - 1
        hits: dict[int, int] = {}
        for i in own:
            at = i - 1
            if at >= 0 and jump[at] != at:
                path = [at]
                at = jump[at]
                while at >= 0 and jump[at] != at:
                    path.append(at)
                    at = jump[at]
                for p in path:
                    jump[p] = at
            smaller[i] = at
            if at >= 0:
                hits[at] = hits.get(at, 0) + 1
        if hits:
            moved: dict[tuple[int, int], list[int]] = {}
            for j, count in hits.items():
                key = (count, owner[j])
                if key in moved:
                    moved[key].append(j)
                else:
                    moved[key] = [j]
            for key in sorted(moved, reverse=True) if len(moved) > 1 else moved:
                old, new = key[1], len(members)
                members.append(moved[key])
                for j in moved[key]:
                    owner[j] = new
                up = above[old]
                above[old] = new
                above.append(up)
                below.append(old)
                if up >= 0:
                    below[up] = new
        group = below[group]

    # The groups in ascending order: their first places.
    first = [0] * len(members)
    group, place = 0, 0
    while below[group] >= 0:
        group = below[group]
    while group >= 0:
        first[group] = place
        place += len(members[group])
        group = above[group]

    order = [-1] * n
    placed = bytearray(n)

    def emit(j: int) -> None:
        while j >= 0 and not placed[j]:
            g = owner[j]
            order[first[g]] = j
            first[g] += 1
            placed[j] = 1
            j = smaller[j]

    emit(n - 1)  # what comes before the end of the text comes first
    for k in range(n):
        if order[k] > 0:
            emit(order[k] - 1)
    return order
