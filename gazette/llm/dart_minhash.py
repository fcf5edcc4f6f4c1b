"""DartMinHash signatures of weighted sets (Christiani, 2020).

Each element owns a plane of weight times rank, cut into cells of area one at most. A cell holds a Poisson number of
darts, all of it a function of element and cell alone, so equal elements throw equal darts in every set. A dart counts
for a set if it lies under the element's weight. Each of ``k`` coordinates keeps its dart of least rank; two sets agree
in a coordinate with the probability of their weighted Jaccard similarity. Ranks are looked at up to a height at which
nearly every coordinate has a dart, and where one has none the height grows by half: about k log k darts a set, however
many elements it has.
"""

from __future__ import annotations

import math

import numpy as np

_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Ranks are cut here, then at 2, 3, ...
_LOW = np.array([0, 1 / 16, 1 / 4, 1 / 2, 1.0])
#: Cells that are worked on together: their arrays stay in a core's cache.
BATCH = 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _cells(heights: np.ndarray) -> np.ndarray:
    """Number of cells of a unit of weight that reach under each height."""
    return np.where(heights > 1, np.ceil(heights).astype(np.int64) + len(_LOW) - 2, np.searchsorted(_LOW, np.minimum(heights, 1.0)))


def _poisson_table() -> np.ndarray:
    """P(N <= n) + c for n = 0, 1, ... of cells of kind c: one for each step of _LOW, then those of area 1. Ascending."""
    rows = []
    for c, area in enumerate([*np.diff(_LOW), 1.0]):
        p = [math.exp(-area)]
        for n in range(1, 25):
            p.append(p[-1] * area / n)
        rows.append(np.minimum(np.cumsum(p), 1.0) + c)
    return np.array(rows)


_TABLE = _poisson_table()


def _darts(elements: np.ndarray, weights: np.ndarray, sets: np.ndarray, heights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, rank, dart) of every dart under the weights and the heights of the elements' sets."""
    units = np.ceil(weights).astype(np.int64)
    if units.max(initial=1) > 1:  # a row for each unit of weight
        row = np.repeat(np.arange(len(elements)), units)
        unit = np.arange(len(row)) - np.repeat(np.cumsum(units) - units, units)
    else:
        row, unit = np.arange(len(elements)), np.zeros(len(elements), np.int64)
    base = mix(elements[row] + _GOLD * unit.astype(np.uint64) + _GOLD)
    cells = _cells(heights[sets[row]])
    owner = np.repeat(np.arange(len(row)), cells)
    cell = np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)
    seed = mix(base[owner] + _GOLD * (cell + 1).astype(np.uint64))
    kind = np.minimum(cell, len(_TABLE) - 1)
    at = _unit(seed) + kind
    some = np.flatnonzero(at >= _TABLE[kind, 0])
    times = np.searchsorted(_TABLE.ravel(), at[some], "right") - kind[some] * _TABLE.shape[1]
    who = np.repeat(some, times)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
    dart = mix(seed[who] ^ mix(nth.astype(np.uint64) + np.uint64(101)))
    place = _unit(mix(dart ^ np.uint64(0x5851F42D4C957F2D)))
    low = cell[who]
    rank = np.where(low < len(_LOW) - 1, _LOW[np.minimum(low, len(_LOW) - 1)] + place * np.append(np.diff(_LOW), 1.0)[np.minimum(low, len(_LOW) - 1)], low - (len(_LOW) - 2) + place)
    mine = row[owner[who]]
    keep = rank < heights[sets[mine]]
    if unit.any() or (weights < 1).any():
        keep &= unit[owner[who]] + _unit(mix(dart ^ np.uint64(0x14057B7EF767814F))) < weights[mine]
    return sets[mine[keep]], rank[keep], dart[keep]


def signatures(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Signatures, k 64-bit integers a set, of sets that stand one after the other in elements; sizes are their numbers of elements, all over 0."""
    n = len(sizes)
    out = np.zeros((n, k), np.uint64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    totals = np.add.reduceat(weights, begin[:-1]) if n else np.zeros(0)
    heights = k * (math.log(k) + 3) / np.maximum(totals, 1e-9)
    due = np.arange(n)
    while due.size:
        again = []
        for some in np.split(due, np.flatnonzero(np.diff(np.cumsum(_cells(heights[due]) * totals[due]) // BATCH)) + 1):
            pick = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in some])
            which, rank, dart = _darts(elements[pick], weights[pick], np.repeat(np.arange(len(some)), sizes[some]), heights[some])
            slot = which * k + (mix(dart ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(k)).astype(np.int64)
            order = np.argsort(-rank)  # the least rank is written last
            got, full = np.zeros(len(some) * k, np.uint64), np.zeros(len(some) * k, bool)
            got[slot[order]] = dart[order]
            full[slot] = True
            whole = full.reshape(-1, k).all(axis=1)
            out[some[whole]] = got.reshape(-1, k)[whole]
            again.append(some[~whole])
        due = np.concatenate(again)
        heights[due] *= 1.5
    return out
