"""Isolation forest of one slice, vectorised over all its trees.

Liu, Ting, Zhou: Isolation Forest, ICDM 2008. Splits are drawn from a small
integer mixer instead of a random stream, so a slice scores the same on every
run, partitioning and engine.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

# Fixed values of the detector.
TREES = 50
SUBSAMPLE = 256

# Constants of the mixer; the modulus is the Mersenne prime 2^31 - 1.
MODULUS = 2147483647
PICK_FEATURE, PICK_THRESHOLD, PICK_ROWS = 1, 2, 3
EULER_GAMMA = 0.5772156649

# Rows times trees scored at a time.
SCORED_CELLS = 1_000_000


def slice_seed(label: str) -> int:
    return int(hashlib.md5(label.encode("utf-8")).hexdigest()[:8], 16) % MODULUS


def mix(seed, tree, item, purpose):
    """A value in [0, MODULUS) for each (tree, item); all inputs are non-negative int64."""
    h = (seed + tree * 1000003 + item * 7919 + purpose * 104729) % MODULUS
    h = (h * h + 12345) % MODULUS
    h = (h * 48271 + tree) % MODULUS
    h = (h * h + 67890) % MODULUS
    h = (h * 16807 + item) % MODULUS
    return (h * h + purpose) % MODULUS


def average_path(count):
    """Expected path length of an unsuccessful search among ``count`` points."""
    n = np.asarray(count, dtype=np.float64)
    big = np.maximum(n, 3.0)
    full = 2.0 * (np.log(big - 1.0) + EULER_GAMMA) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, full))


def _walk(features, base, split_on, threshold, cost, depth):
    """Path length of every row, summed over the trees, in blocks of rows."""
    n, width = features.shape
    values = features.ravel()
    low_bits = (1 << (depth + 1)) - 1
    paths = np.empty(n)
    step = max(1, SCORED_CELLS // TREES)
    for start in range(0, n, step):
        rows = np.arange(start, min(start + step, n))
        who = np.tile(rows * width, TREES)
        at = np.repeat(base.ravel() + 1, len(rows))
        steps = np.zeros(len(at))
        for _ in range(depth):
            feature = split_on[at]
            inner = feature >= 0
            if not inner.any():
                break
            right = values[who + np.maximum(feature, 0)] > threshold[at]
            at = np.where(inner, at + (at & low_bits) + right, at)
            steps += inner
        paths[rows] = (steps + cost[at]).reshape(TREES, len(rows)).sum(axis=0)
    return paths


def _grow(features, rows, seed, paths=None):
    """All trees, each on its own rows: first slot of each tree, and split feature, threshold and path length by slot.

    Adds each row's path lengths to ``paths`` if given, where every tree holds every row once.
    """
    psi = rows.shape[1]
    depth = math.ceil(math.log2(max(psi, 2)))
    trees = np.arange(TREES, dtype=np.int64)
    slots = TREES << (depth + 1)  # heap-numbered nodes of every tree side by side
    base = trees[:, None] << (depth + 1)
    count = np.zeros(slots, dtype=np.int64)
    split_on = np.full(slots, -1, dtype=np.int64)
    threshold = np.zeros(slots)

    def reached(sample, at, level):
        if paths is not None:
            paths[:] += np.bincount(sample, weights=level + average_path(count[at]), minlength=len(paths))

    sample = rows.ravel()
    at = np.broadcast_to(base + 1, rows.shape).ravel()
    for level in range(depth + 1):
        if not len(at):
            break
        order = np.argsort(at, kind="stable")
        sample, at = sample[order], at[order]
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        nodes = at[start]
        count[nodes] = np.diff(np.r_[start, len(at)])
        if level == depth:
            reached(sample, at, level)
            break
        values = features[sample]
        low = np.minimum.reduceat(values, start, axis=0)
        high = np.maximum.reduceat(values, start, axis=0)
        varies = high > low
        choices = varies.sum(axis=1)
        tree, heap = nodes >> (depth + 1), nodes & ((1 << (depth + 1)) - 1)
        pick = mix(seed, tree, heap, PICK_FEATURE) * choices // MODULUS
        chosen = np.argmax((np.cumsum(varies, axis=1) == (pick + 1)[:, None]) & varies, axis=1)
        here = np.arange(len(nodes))
        lo, hi = low[here, chosen], high[here, chosen]
        cut = lo + (mix(seed, tree, heap, PICK_THRESHOLD) / MODULUS) * (hi - lo)
        cut = np.where(cut >= hi, lo, cut)
        split_on[nodes] = np.where(choices > 0, chosen, -1)
        threshold[nodes] = cut

        inner = split_on[at] >= 0
        reached(sample[~inner], at[~inner], level)
        sample, at = sample[inner], at[inner]
        right = features[sample, split_on[at]] > threshold[at]
        at = at + (at & ((1 << (depth + 1)) - 1)) + right  # doubles the heap number, keeps the tree
    return base, split_on, threshold, average_path(count), depth


def _scores(paths, psi):
    return -np.round(np.power(2.0, -(paths / TREES) / float(average_path(psi))), 8)


def forest_scores(features: np.ndarray, days: np.ndarray, seed: int, contamination: float):
    """Decision value and outlier flag for every row of one slice."""
    n = len(features)
    psi = min(SUBSAMPLE, n)
    if n > psi:  # rows outside a tree's sample still have to walk down it
        rows = np.empty((TREES, psi), dtype=np.int64)
        for t in range(TREES):
            rows[t] = np.lexsort((days, mix(seed, t, days, PICK_ROWS)))[:psi]
        paths = _walk(features, *_grow(features, rows, seed))
    else:
        paths = np.zeros(n)
        _grow(features, np.broadcast_to(np.arange(n), (TREES, n)), seed, paths)
    scores = _scores(paths, psi)
    decision = np.round(scores - np.percentile(scores, 100.0 * contamination), 8)
    return decision, decision < 0


def _sampled_days(days: np.ndarray, gaps: np.ndarray, seed: int, psi: int) -> np.ndarray:
    """The days each tree samples: the first ``psi`` by the mixer among all days, gaps included, a stretch of days at a time."""
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * TREES
    ends = np.cumsum(gaps + 1)
    for start in range(0, int(ends[-1]), SCORED_CELLS):
        number = np.arange(start, min(start + SCORED_CELLS, int(ends[-1])))
        run = np.searchsorted(ends, number, "right")
        day = days[run] + number - (ends[run] - gaps[run] - 1)
        for t in range(TREES):
            drawn, held = np.concatenate((best[t][0], mix(seed, t, day, PICK_ROWS))), np.concatenate((best[t][1], day))
            if len(held) > psi:
                bar = np.partition(drawn, psi - 1)[psi - 1]
                near = np.flatnonzero(drawn <= bar)
                first = near[np.lexsort((held[near], drawn[near]))[:psi]]
                drawn, held = drawn[first], held[first]
            best[t] = drawn, held
    return np.stack([held for _, held in best])


def run_forest_scores(observed: np.ndarray, filled: np.ndarray, days: np.ndarray, gaps: np.ndarray, seed: int, contamination: float):
    """Decision value and outlier flag of the observed days of one slice whose gaps are given by their lengths.

    Run ``i`` is an observed day and the ``gaps[i]`` days after it, whose features are ``filled[i]``. The result is that of
    ``forest_scores`` over all days, but a gap is one point with a weight.
    """
    n, count = int((gaps + 1).sum()), len(days)
    psi = min(SUBSAMPLE, n)
    points = np.concatenate((observed, filled))
    picked = _sampled_days(days, gaps, seed, psi)
    run = np.searchsorted(days, picked, "right") - 1
    rows = np.where(days[run] == picked, run, run + count)
    scores = _scores(_walk(points, *_grow(points, rows, seed)), psi)
    weights = np.concatenate((np.ones(count, np.int64), gaps))
    order = np.argsort(scores, kind="stable")
    upto = np.cumsum(weights[order])
    place = contamination * (n - 1)
    low = scores[order][np.searchsorted(upto, math.floor(place), "right")]
    high = scores[order][np.searchsorted(upto, min(math.floor(place) + 1, n - 1), "right")]
    decision = np.round(scores[:count] - (low + (high - low) * (place - math.floor(place))), 8)
    return decision, decision < 0
