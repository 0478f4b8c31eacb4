"""A tree of cells over vectors: cuts along data-chosen directions, and the cells that a neighbour can be in.

For unit p, |p.x - p.y| <= |x - y|.  So if x and y are at most w apart, either both are on one side of a cut, or both are within w of
it: a row that visits the other side of every cut that is within w of it meets all its neighbours, and cells beyond are skipped without
loss.  A cell also has a box, the range of all its rows along AXES orthonormal directions and of the length of what is left of them; a row
whose distance from a box is above w has no neighbour in it, since a distance is at least that of the projections.  Tree and axes are fitted
on a bounded sample; that decides how well cells separate, never what is found.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the sample, rows of it in a cell at least, directions tried for a cut, and axes of a box.
SAMPLE_ROWS, LEAST_ROWS, DIRECTIONS, AXES = 65_536, 32, 3, 48
#: Numbers compared with boxes at once.
SLICE = 1 << 20
#: What is added to a width against rounding.
SLACK = 1e-6


class Cells:
    """Nodes as arrays; a child >= 0 is a node, below 0 the cell -1 - child."""

    def __init__(self, directions: np.ndarray, cuts: np.ndarray, children: np.ndarray):
        self.directions, self.cuts, self.children = directions, cuts, children
        self.count = len(cuts) + 1
        self.axes = self.low = self.high = None

    @classmethod
    def fit(cls, sample: np.ndarray, width: float, seed: int = 1) -> Cells:
        """Cut while a cut leaves fewer pairs to compare, and both sides have LEAST_ROWS rows."""
        random = np.random.default_rng(seed)
        directions, cuts, children = [], [], []
        cells = 0
        todo = [(np.arange(len(sample)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            found = _best_cut(sample[rows], width, LEAST_ROWS, random)
            if found is None:
                name, cells = -1 - cells, cells + 1
            else:
                name = len(cuts)
                directions.append(found[0])
                cuts.append(found[1])
                children.append([0, 0])
                right = sample[rows] @ found[0] > found[1]
                todo += [(rows[right], name, 1), (rows[~right], name, 0)]
            if parent is not None:
                children[parent][side] = name
        d = max(sample.shape[1], 1)
        tree = cls(np.array(directions, np.float64).reshape(-1, d), np.array(cuts, np.float64), np.array(children, np.int64).reshape(-1, 2))
        axes = _leading(sample - sample.mean(axis=0), min(AXES, d), random) if len(sample) > 1 else None
        # Axes of a sample in 32 bits are orthonormal to 64.
        tree.axes = np.zeros((0, d)) if axes is None else np.linalg.qr(axes.astype(np.float64))[0].T
        return tree

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        """What boxes are made of: the projections on the axes, and the length of the rest."""
        at = x @ self.axes.T
        rest = (x * x).sum(axis=1) - (at * at).sum(axis=1)
        return np.concatenate((at, np.sqrt(np.maximum(rest, 0))[:, None]), axis=1)

    def boxes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cells, lowest, highest coordinates) of the rows' cells."""
        cell = self.homes(x)
        order = np.argsort(cell, kind="stable")
        found, first = np.unique(cell[order], return_index=True)
        at = self.coordinates(x)[order]
        return found, np.minimum.reduceat(at, first, axis=0), np.maximum.reduceat(at, first, axis=0)

    def bounded(self, low: np.ndarray, high: np.ndarray) -> Cells:
        """The tree with boxes of all rows; a cell without rows has none, and nothing visits it."""
        self.low, self.high = low, high
        return self

    def within(self, width: float) -> np.ndarray:
        """Which cells can hold rows within `width` of rows of another, by their boxes: one bit for two cells; a cell without rows is near none."""
        out = np.empty((self.count, self.count), bool)
        for c in range(self.count):
            with np.errstate(invalid="ignore"):
                gap = np.maximum(np.maximum(self.low - self.high[c], self.low[c] - self.high), 0)
            out[c] = np.sqrt((gap * gap).sum(axis=1)) <= width + SLACK
        return out

    def _near(self, x: np.ndarray, row: np.ndarray, cell: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Which of the (row, cell) have the row within its width of the cell's box."""
        at = self.coordinates(x)
        out = np.empty(len(row), bool)
        step = max(1, SLICE // at.shape[1])
        for i in range(0, len(row), step):
            r, c = row[i : i + step], cell[i : i + step]
            gap = np.maximum(np.maximum(self.low[c] - at[r], at[r] - self.high[c]), 0)
            out[i : i + step] = np.sqrt((gap * gap).sum(axis=1)) <= width[r]
        return out

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The cell of every row."""
        return self._walk(x, np.zeros(len(x)), True, False)[1]

    def meetings(self, x: np.ndarray, width: float | np.ndarray, *, once: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, guest): every row in its own cell, and as a guest in the other cells that hold rows within `width` (one for all, or one a row).

        With `once`, two rows meet in one cell only, in that of the one on the lower side of the first cut between them, where the other is a guest.
        """
        width = np.broadcast_to(np.asarray(width, np.float64) + SLACK, len(x))
        row, cell, guest = self._walk(x, width, once, True)
        if self.low is not None and guest.any():
            keep = ~guest
            keep[guest] = self._near(x, row[guest], cell[guest], width)
            row, cell, guest = row[keep], cell[keep], guest[keep]
        return row, cell, guest

    def _walk(self, x, width, once, guests):
        out_row, out_cell, out_guest = [], [], []
        todo = [(0 if len(self.cuts) else -1, np.arange(len(x)), np.zeros(len(x), bool))]
        while todo:
            node, rows, guest = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out_row.append(rows)
                out_cell.append(np.full(len(rows), -1 - node))
                out_guest.append(guest)
                continue
            at = x[rows] @ self.directions[node]
            cut, w = self.cuts[node], width[rows]
            low = at <= cut
            near_low, near_high = at <= cut + w, at > cut - w
            if guests:
                left, right = near_low, (np.where(guest, near_high, ~low) if once else near_high)
            else:
                left, right = low, ~low
            for child, take, own in ((self.children[node, 0], left, low), (self.children[node, 1], right, ~low)):
                todo.append((child, rows[take], guest[take] | ~own[take]))
        if not out_row:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        row, cell, guest = np.concatenate(out_row), np.concatenate(out_cell), np.concatenate(out_guest)
        order = np.argsort(row, kind="stable")
        return row[order], cell[order], guest[order]


def _leading(centred: np.ndarray, k: int, random) -> np.ndarray | None:
    """k orthonormal columns near the leading directions, by subspace iteration; None if all rows are equal."""
    q = np.linalg.qr(random.standard_normal((centred.shape[1], k)))[0].astype(centred.dtype)
    for _ in range(6):
        onward = centred.T @ (centred @ q)
        if not np.abs(onward).max() > 0:
            return None
        q = np.linalg.qr(onward)[0]
    return q


def _best_cut(x: np.ndarray, width: float, least: int, random) -> tuple[np.ndarray, float] | None:
    """The direction and cut with the smallest share of pairs left, if that is well below 1."""
    n, d = x.shape
    if n < 2 * least:
        return None
    q = _leading(x - x.mean(axis=0), min(DIRECTIONS, d), random)
    if q is None:
        return None
    best = (0.9, None)
    for p in q.T:
        at = np.sort(x @ p)
        for share in (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8):
            cut = float(at[int(share * n) - 1])
            low = np.searchsorted(at, cut, "right") / n
            guest = np.searchsorted(at, cut + width, "right") / n - low
            left = low * low + (1 - low) ** 2 + 2 * low * guest
            if left < best[0] and least <= low * n <= n - least:
                best = (left, (p.copy(), cut))
    return best[1]


def sample_of(rows: DataFrame, item: str, vector: str | Column, many: int, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """About `sample_rows` vectors of `many`, drawn by a hash of their item."""
    share = min(1.0, sample_rows / max(many, 1))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit("cells"), F.col(item)), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows
    got = drawn.select(F.col(vector).alias("v") if isinstance(vector, str) else vector.alias("v")).limit(2 * sample_rows).toArrow().column("v").combine_chunks()
    return got.flatten().to_numpy(zero_copy_only=False).reshape(len(got), -1) if len(got) else np.zeros((0, 0))
