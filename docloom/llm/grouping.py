"""Bin packing of a length histogram by a grouping genetic algorithm.

A solution is its groups: kinds of bins, each a tuple of (length, copies) runs, with the number of bins of that kind. Crossover
injects whole well-filled bins of one parent, drops bins of the other whose documents the injected ones already hold, and
best-fits the displaced documents. Groups carry counts, so a step costs by the different lengths, not by the documents.
"""

from __future__ import annotations

import bisect
import functools
import math
import random
from collections import Counter
from dataclasses import dataclass

Kind = tuple[tuple[int, int], ...]
#: Bins of each kind; a kind's runs are sorted, longest first.
Groups = dict[Kind, int]


@functools.lru_cache(1 << 16)
def load(kind: Kind) -> int:
    return sum(length * copies for length, copies in kind)


def least_bins(histogram: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: the sum of lengths, or the lengths that can't share a bin with more than half of it left to the rest."""
    total = sum(n * k for n, k in histogram.items())
    best = -(-total // capacity)
    for short in sorted({n for n in histogram if 2 * n <= capacity}):
        alone = sum(k for n, k in histogram.items() if n > capacity - short)
        half = sum(k for n, k in histogram.items() if capacity - short >= n and 2 * n > capacity)
        left = sum(n * k for n, k in histogram.items() if short <= n and 2 * n <= capacity)
        room = half * capacity - sum(n * k for n, k in histogram.items() if capacity - short >= n and 2 * n > capacity)
        best = max(best, alone + half + max(0, math.ceil((left - room) / capacity)))
    return best


def count(groups: Groups) -> int:
    return sum(groups.values())


def held(groups: Groups) -> Counter:
    out: Counter = Counter()
    for kind, bins in groups.items():
        for length, copies in kind:
            out[length] += copies * bins
    return out


def fitness(groups: Groups, capacity: int) -> tuple[int, float]:
    """Less is better: bins, then how evenly the room is spread over them."""
    return count(groups), -sum(bins * (load(kind) / capacity) ** 2 for kind, bins in groups.items())


def _with(kind: Kind, length: int, copies: int) -> Kind:
    runs = dict(kind)
    runs[length] = runs.get(length, 0) + copies
    return tuple(sorted(runs.items(), reverse=True))


class _Open:
    """Bins by their room, to find the least room that a length fits."""

    def __init__(self, groups: Groups, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, Groups] = {}
        self.rooms: list[int] = []
        for kind, bins in groups.items():
            self.put(kind, bins)

    def put(self, kind: Kind, bins: int) -> None:
        room = self.capacity - load(kind)
        if room not in self.by_room:
            self.by_room[room] = {}
            bisect.insort(self.rooms, room)
        kinds = self.by_room[room]
        kinds[kind] = kinds.get(kind, 0) + bins

    def take(self, length: int) -> tuple[Kind, int]:
        """A kind with the least room that holds ``length``; an empty bin's kind and 0 if there is none."""
        at = bisect.bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return (), 0
        room = self.rooms[at]
        kinds = self.by_room[room]
        found = kinds.popitem()
        if not kinds:
            del self.by_room[room], self.rooms[at]
        return found

    def groups(self) -> Groups:
        return {kind: bins for kinds in self.by_room.values() for kind, bins in kinds.items()}


def best_fit(groups: Groups, displaced: list[tuple[int, int]], capacity: int) -> Groups:
    """``groups`` with the displaced (length, number) added in their order, each to a bin with the least room that holds it, else to a new one."""
    bins = _Open(groups, capacity)
    for length, left in displaced:
        while left:
            kind, found = bins.take(length)
            copies = max(1, min((capacity - load(kind)) // length, left // found if found else left))
            if not found:
                found = left // copies
                bins.put(_with(kind, length, copies), found)
                left -= copies * found
            else:
                used = min(found, left // copies)
                bins.put(_with(kind, length, copies), used)
                if used < found:
                    bins.put(kind, found - used)
                left -= copies * used
    return bins.groups()


def _order(lengths: Counter, rng: random.Random, spread: float) -> list[tuple[int, int]]:
    """(length, number), longest first but for a random factor within ``spread``."""
    return sorted(((n, k) for n, k in lengths.items() if k), key=lambda x: -x[0] * (1 + spread * (rng.random() - 0.5)))


def first(histogram: dict[int, int], capacity: int, rng: random.Random, spread: float) -> Groups:
    return best_fit({}, _order(Counter(histogram), rng, spread), capacity)


def crossover(histogram: dict[int, int], giver: Groups, taker: Groups, capacity: int, rng: random.Random) -> Groups:
    """A child that has whole well-filled bins of ``giver``, bins of ``taker`` that hold no document twice, and the rest best-fitted."""
    left = Counter(histogram)
    child: Groups = {}

    def keep(kind: Kind, bins: int) -> None:
        bins = min([bins, *(left[n] // k for n, k in kind)])
        if bins > 0:
            child[kind] = child.get(kind, 0) + bins
            for n, k in kind:
                left[n] -= k * bins

    filled = sorted(giver, key=load, reverse=True)
    for kind in filled[: max(1, len(filled) // 2)]:
        if rng.random() < 0.6:
            keep(kind, giver[kind])
    for kind in sorted(taker, key=load, reverse=True):
        keep(kind, taker[kind])
    return best_fit(child, _order(left, rng, 0.1), capacity)


def mutate(groups: Groups, capacity: int, rng: random.Random) -> Groups:
    """Open the worst-filled bins and some others, and best-fit what was in them."""
    by_load = sorted(groups, key=lambda k: load(k) + rng.random())
    opened = set(by_load[: rng.randint(1, max(2, len(by_load) // 20))])
    share = rng.choice((0.01, 0.05, 0.2))
    opened |= {k for k in by_load if rng.random() < share}
    loose: Counter = Counter()
    for kind in opened:
        for n, k in kind:
            loose[n] += k * groups[kind]
    return best_fit({k: b for k, b in groups.items() if k not in opened}, _order(loose, rng, rng.choice((0.0, 0.1, 0.5))), capacity)


@dataclass(frozen=True)
class Setting:
    islands: int = 6
    members: int = 6
    generations: int = 8
    rounds: int = 3


def evolve(histogram: dict[int, int], population: list[Groups], capacity: int, setting: Setting, rng: random.Random) -> list[Groups]:
    """The population after ``generations``, best first; it ends early at the least number of bins possible."""
    rate = lambda g: fitness(g, capacity)
    least = least_bins(histogram, capacity)

    def best(found: list[Groups]) -> list[Groups]:  # equal ratings hold equal solutions, which would fill the population
        return sorted({rate(g): g for g in reversed(found)}.values(), key=rate)[: setting.members]

    population = list(population)
    while len(population) < setting.members:  # the first by plain best-fit decreasing, others in disturbed orders
        population.append(first(histogram, capacity, rng, 0.0 if not population else 0.1 * len(population)))
    population = best(population)
    for _ in range(setting.generations):
        if count(population[0]) <= least:
            break
        children = []
        for _ in range(setting.members):
            a, b = (min(rng.choices(population, k=2), key=rate) for _ in range(2))
            child = crossover(histogram, a, b, capacity, rng)
            children.append(mutate(child, capacity, rng) if rng.random() < 0.5 else child)
        population = best(population + children)
    return population
