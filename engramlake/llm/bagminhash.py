"""BagMinHash signatures of shingle multisets, for many texts at once.

An element that occurs c times is a weight c on the grid 0, 1, 2, ... The weights above zero are
split into dyadic intervals [0, 1), [1, 2), [2, 4), [4, 8), ...; each element has an independent
Poisson process in every interval, of a rate in proportion to the interval's length, whose points
carry a time, a signature component and a position in the interval. A component's value for a
multiset is the earliest time among the points below the element's weight, so two multisets agree
in a component with the probability of their weighted Jaccard similarity (the sum of the smaller
counts over the sum of the larger). Work is O(log c) for an element, and only the points up to a
horizon are made: the horizon is chosen so that the components fill, and is doubled, for the texts
where one is still empty, until all have.
"""

from __future__ import annotations

import numpy as np

from engramlake.llm.tokens import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)


def multisets(gram: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, gram) pairs, sorted, with their counts."""
    order = np.lexsort((gram, owner))
    g, o = gram[order], owner[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return g[at], o[at], np.diff(np.append(at, len(g)))


def _dyadic(gram: np.ndarray, owner: np.ndarray, count: np.ndarray):
    """One row per element and interval: key, owner, interval length, and how far into the interval the count reaches."""
    keys, owners, lengths, reach = [], [], [], []
    level, low, rest = 0, 0, np.arange(len(gram))
    while len(rest):
        length = 1 if level < 2 else 1 << (level - 1)
        keys.append(mix(gram[rest] + np.array([level + 1], np.uint64) * _STEP))
        owners.append(owner[rest])
        lengths.append(np.full(len(rest), length, dtype=np.float64))
        reach.append(np.minimum(count[rest] - low, length).astype(np.float64))
        low += length
        level += 1
        rest = rest[count[rest] > low]
    return tuple(np.concatenate(x) for x in (keys, owners, lengths, reach)) if keys else ()


def signatures(gram: np.ndarray, owner: np.ndarray, count: np.ndarray, texts: int, m: int) -> np.ndarray:
    """Array (texts, m) of float64 times; infinite for a text without elements."""
    out = np.full(texts * m, np.inf)
    if len(gram):
        key, of, length, reach = _dyadic(gram, owner, count)
        total = np.bincount(owner, weights=count, minlength=texts)
        horizon = np.where(total > 0, (np.log(m) + 2.7) / np.maximum(total, 1), 0.0)
        todo = total > 0
        while todo.any():
            pick = todo[of]
            _fill(out, key[pick], of[pick], length[pick], reach[pick], horizon, m)
            todo = np.isinf(out.reshape(texts, m)).any(axis=1) & (total > 0)
            horizon = horizon * 2
    return out.reshape(texts, m)


def _fill(out, key, of, length, reach, horizon, m) -> None:
    """Take the points of the processes up to each text's horizon into the signatures."""
    now, rate, until = np.zeros(len(key)), length * m, horizon[of]
    wide = bool(length.max(initial=1) > 1)
    z = key
    while len(z):
        z = mix(z + _STEP)
        now = now - np.log(((z >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / rate
        live = now <= until
        z, of, now, rate, until = z[live], of[live], now[live], rate[live], until[live]
        at = of * m + ((z & np.uint64(0xFFFFFF)) * np.uint64(m) >> np.uint64(24)).astype(np.int64)
        if wide:
            length, reach = length[live], reach[live]
            place = (mix(z ^ _STEP) >> np.uint64(11)).astype(np.float64) * 2.0**-53 * length
            inside = place < reach
            np.minimum.at(out, at[inside], now[inside])
        else:
            np.minimum.at(out, at, now)


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """Array (texts, m // rows) of int64: one hash for each band of a signature."""
    texts, m = sig.shape
    bits = sig[:, : m // rows * rows].copy().view(np.uint64).reshape(texts, m // rows, rows)
    h = np.arange(1, m // rows + 1, dtype=np.uint64)[None, :] * _STEP + np.zeros((texts, 1), np.uint64)
    for k in range(rows):
        h = mix(h * np.uint64(31) + bits[:, :, k])
    return h.view(np.int64)


def overlap(a: np.ndarray, ca: np.ndarray, b: np.ndarray, cb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets given as sorted distinct elements with counts."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[i], cb[j]).sum())
    whole = int(ca.sum()) + int(cb.sum()) - both
    return both / whole if whole else 1.0
