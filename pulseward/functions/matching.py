"""Pivots of vectors, and the tickets of a task against a stream of queries, best matches only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pulseward.functions.vectors import dense_rows

# Scores are compared to so many digits; what is beyond is the rounding of their sums.
SIMILARITY_DIGITS = 12
# Angles come from cosines of vectors stored as single floats; a bound is widened by what that can be off.
ANGLE_SLACK = 1e-6

# Vectors that pivots are fitted to, pivots at most, and rounds of the fit.
PIVOT_SAMPLE, PIVOTS, PIVOT_ROUNDS = 2048, 64, 5


def unit_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a direction, and those scaled to length one."""
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    usable = np.isfinite(norms) & (norms > 0)
    return usable, matrix[usable] / norms[usable][:, None]


def fit_pivots(vectors: pa.Array) -> dict[int, np.ndarray]:
    """Directions that the vectors of each length lie around: a few rounds of spherical k-means."""
    out = {}
    for _, matrix in dense_rows(vectors):
        _, unit = unit_rows(matrix)
        unit = np.unique(unit, axis=0)
        if not len(unit):
            continue
        count = min(PIVOTS, max(1, len(unit) // 8))
        centres = unit[np.linspace(0, len(unit) - 1, count).astype(int)]
        for _ in range(PIVOT_ROUNDS):
            nearest = (unit @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, unit)
            moved, directions = unit_rows(sums)
            centres[moved] = directions
        out[matrix.shape[1]] = centres
    return out


def angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


class Best:
    """The running best k tickets of one query."""

    def __init__(self, k: int, minimum: float):
        self.k, self.least = k, minimum
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0)

    def reached_by(self, bound: float) -> bool:
        """Whether a score up to ``bound`` can still be among the best."""
        return bound >= self.least - 10.0**-SIMILARITY_DIGITS

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        fine = scores >= self.least
        ids, scores = np.concatenate((self.ids, ids[fine])), np.concatenate((self.scores, scores[fine]))
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.least = max(self.least, float(self.scores[-1]))


class TicketCells:
    """The tickets of one task by cell: ids and directions."""

    def __init__(self, rows: pa.Table):
        self.cells = {}
        cells = rows["cell"].to_numpy()
        ids = rows["id"].to_numpy()
        for at, matrix in dense_rows(rows["vector"]):
            usable, unit = unit_rows(matrix)
            mine = at[usable]
            order = np.argsort(cells[mine], kind="stable")
            starts = np.flatnonzero(np.diff(cells[mine][order], prepend=cells[mine][order][:1] - 1))
            for part in np.split(order, starts[1:]):
                if len(part):
                    self.cells[int(cells[mine][part[0]])] = ids[mine][part], unit[part]

    def search(self, asked: np.ndarray, visits: list[dict], best: Best) -> tuple[int, int]:
        """Look at the cells in the order of their bounds until none can add anything; (tickets compared, skipped)."""
        usable, unit = unit_rows(np.asarray([asked], np.float64))
        compared = skipped = 0
        for visit in sorted(visits, key=lambda v: -v["bound"]):
            held = self.cells.get(visit["cell"])
            if held is None or not len(unit):
                continue
            ids, vectors = held
            if best.reached_by(visit["bound"]):
                best.add(ids, np.round(vectors @ unit[0], SIMILARITY_DIGITS))
                compared += len(ids)
            else:
                skipped += len(ids)
        return compared, skipped
