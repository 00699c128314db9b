"""The k nearest gallery rows of one block of queries by several metrics, gallery rows offered in pieces.

Cheap screens stand before the exact distances of ``blocks.paired``, which alone decide:

* one product of unit vectors in single precision serves the cosine and both Euclidean metrics;
* Manhattan distances come from components rounded to ``LEVELS`` steps of a common grid,
  as |a - b| = a + b - 2 min(a, b): a sum of the smaller ones, in bytes. What rounding (and clipping
  at the ends of the grid) took from a vector is summed up and bounds the error of its distances.

A pair passes a screen if its distance can be within the k-th one known so far. Where a screen lets
many pass (near copies, far outliers), ``blocks.screen`` looks at them again in double precision.
"""

from __future__ import annotations

import numpy as np

from shotline.functions import blocks

ROWS = 256  # queries screened together
COLUMNS = 2_048  # gallery rows screened together; longer rows are slower by a multiple
BYTE_ROWS = 128  # queries whose sums of bytes stay in the cache
LEVELS = 63  # steps of the grid
GROUP = 4  # sums of as many steps fit a byte
SAMPLE = 4_096  # about so many rows of a side place the grid, which decides on speed only
CROWD = 64  # a query that one gallery row in so many passes for is looked at again
WAITING = 1 << 18  # pairs that wait for their exact distance before a further tile adds its own
ALIKE = 1e-3  # where lengths differ by less, the product alone decides
EPS32 = float(np.finfo(np.float32).eps)


class Finder:
    def __init__(self, q: blocks.Block, k: int, metrics: tuple[str, ...]):
        self.k, self.metrics = k, metrics
        length = np.linalg.norm(q.matrix, axis=1)
        self.kept = np.flatnonzero(np.isfinite(length))  # others have no distances
        self.raw, self.length = q.matrix[self.kept], length[self.kept]
        self.unit = blocks.prepared(self.raw, "cosine", False)
        self.unit32 = self.unit.astype(np.float32)
        self.reach = {m: np.full(len(self.kept), np.inf) for m in metrics}
        self.best = {m: None for m in metrics}  # queries, ids, labels, distances; by query, distance, id
        self.waiting: dict[str, list] = {m: [] for m in metrics}
        self.lowest = None
        self.room: dict[str, np.ndarray] = {}

    def offer(self, g: blocks.Block) -> None:
        """Compare with further gallery rows."""
        whole = np.flatnonzero(np.isfinite(np.linalg.norm(g.matrix, axis=1)))
        if not len(whole) or not len(self.kept):
            return
        if self.lowest is None and "manhattan" in self.metrics:
            self._place(g.matrix[whole])
        for start in range(0, len(whole), COLUMNS):
            part = whole[start : start + COLUMNS]
            part = part[_first(g.matrix[part], g.ids[part], self.k)]
            self._piece(blocks.Block(g.ids[part], g.labels[part], g.matrix[part]))

    def found(self, metric: str):
        """(query rows, ids, labels, distances, ranks) by query and rank; None if there are none."""
        if self.best[metric] is None:
            return None
        rows, ids, labels, dist = self.best[metric]
        return self.kept[rows], ids, labels, dist, _places(rows) + 1

    def _place(self, matrix: np.ndarray) -> None:
        """A grid over nearly all of both sides, with one step for all components."""
        some = [m[:: max(1, len(m) // SAMPLE)] for m in (self.raw, matrix)]
        low, high = np.percentile(np.vstack(some), [0.1, 99.9], axis=0)
        step = (high - low).max() / LEVELS
        self.lowest, self.step = low, step if step > 0 else 1.0
        self.marks, self.marked, self.lost = self._rounded(self.raw)

    def _rounded(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Steps of each component, their sum, and a bound of what rounding took, in steps."""
        at = (matrix - self.lowest) / self.step
        marks = np.clip(np.rint(at), 0, LEVELS)
        size = (np.abs(matrix).sum(1) + np.abs(self.lowest).sum()) / self.step + LEVELS * matrix.shape[1]
        return marks.astype(np.uint8), marks.sum(1), np.abs(at - marks).sum(1) + 16 * blocks.EPS * size

    def _room(self, name: str, rows: int, columns: int, kind) -> np.ndarray:
        """Memory for a tile, kept for the next one of its width."""
        if (held := self.room.get(name)) is None or held.shape[1] != columns:
            held = self.room[name] = np.empty((max(rows, ROWS), columns), kind)
        return held[:rows]

    def _sides(self, metric: str) -> str:
        return "raw" if metric in ("euclidean", "manhattan") else "unit"

    def _piece(self, g: blocks.Block) -> None:
        given = {"raw": g.matrix, "unit": blocks.prepared(g.matrix, "cosine", True)}
        columns = np.ascontiguousarray(given["unit"].T, dtype=np.float32)
        length = np.linalg.norm(g.matrix, axis=1)
        stepped = self._leads(g.matrix) if "manhattan" in self.metrics else None
        for start in range(0, len(self.kept), ROWS):
            rows = slice(start, start + ROWS)
            product = None
            if set(self.metrics) != {"manhattan"}:
                asked = self.unit32[rows]
                product = np.dot(asked, columns, out=self._room("product", len(asked), len(g), np.float32))
                highest = product.max(1)
            for metric in self.metrics:
                if metric == "manhattan":
                    score, limit = self._sums(rows, *stepped), self._manhattan_limit
                elif metric == "cosine":
                    score, limit = product, self._cosine_limit
                else:
                    score, limit = self._halves(metric, rows, product, length)
                top = highest if score is product else score.max(1)
                self._pass(metric, rows, score, top, limit, given[self._sides(metric)])
                if sum(len(r) for r, _ in self.waiting[metric]) > WAITING:
                    self._settle(metric, g, given[self._sides(metric)])
        for metric in self.metrics:
            self._settle(metric, g, given[self._sides(metric)])

    def _cosine_limit(self, rows: slice, far: np.ndarray) -> np.ndarray:
        return 1.0 - far - EPS32 * (self.raw.shape[1] + 16)

    def _halves(self, metric: str, rows: slice, product: np.ndarray, length: np.ndarray):
        """What falls as Euclidean distances grow: products less half the squared lengths of gallery rows."""
        here, scale = self.length[rows], 1.0
        if metric == "euclidean":  # lengths up to one: no overflow
            scale = max(length.max(), here.max(), np.finfo(float).tiny)
        else:
            here, length = (here > 0).astype(float), (length > 0).astype(float)
        here, there = here / scale, length / scale
        error = EPS32 * (self.raw.shape[1] + 16)
        low, high = there.min(), there.max()

        def angle(_: slice, far: np.ndarray) -> np.ndarray:
            gap = here * here - (far / scale) ** 2
            best = np.clip(np.sqrt(np.maximum(gap, 0.0)), low, high)  # the length that reaches farthest
            return (gap / best + best) / (2 * here) - error

        def limit(_: slice, far: np.ndarray) -> np.ndarray:
            return (here * here - (far / scale) ** 2) / 2 - error * high * (here + high)

        if low > high * (1 - ALIKE) and here.min() > 1e-6:
            return product, angle
        score = self._room("halves", *product.shape, np.float32)
        np.multiply(product, there.astype(np.float32), out=score)
        score *= here.astype(np.float32)[:, None]
        score -= (there * there / 2).astype(np.float32)
        return score, limit

    def _leads(self, matrix: np.ndarray):
        """Steps by component, and what each gallery row's sum starts from."""
        marks, marked, lost = self._rounded(matrix)
        most = LEVELS * marks.shape[1]  # no limit is above it
        kind = np.int16 if 2 * most < np.iinfo(np.int16).max else np.int32
        lead = np.minimum(np.ceil((lost - marked) / 2) + 1, most).astype(kind)
        return np.ascontiguousarray(marks.T), lead

    def _sums(self, rows: slice, marks: np.ndarray, lead: np.ndarray) -> np.ndarray:
        asked = self.marks[rows]
        total = self._room("total", len(asked), len(lead), lead.dtype)
        total[:] = lead
        few, one = (self._room(name, BYTE_ROWS, len(lead), np.uint8) for name in ("few", "one"))
        for start in range(0, len(asked), BYTE_ROWS):
            part = asked[start : start + BYTE_ROWS]
            sums, a, b = total[start : start + BYTE_ROWS], few[: len(part)], one[: len(part)]
            for first in range(0, len(marks), GROUP):
                np.minimum(part[:, first, None], marks[first], out=a)
                for j in range(first + 1, min(first + GROUP, len(marks))):
                    np.minimum(part[:, j, None], marks[j], out=b)
                    np.add(a, b, out=a)
                np.add(sums, a, out=sums)
        return total

    def _manhattan_limit(self, rows: slice, far: np.ndarray) -> np.ndarray:
        return np.floor((self.marked[rows] - far / self.step - self.lost[rows]) / 2) - 1

    def _pass(self, metric: str, rows: slice, score: np.ndarray, top: np.ndarray, limit, given: np.ndarray) -> None:
        """Keep the pairs of a tile whose distances can be among the k smallest."""
        asked = (self.raw if self._sides(metric) == "raw" else self.unit)[rows]
        reach = self.reach[metric][rows].copy()
        fresh = np.flatnonzero(np.isinf(reach))
        if len(fresh) and score.shape[1] >= self.k:  # any k rows bound the k-th distance
            if self.k == 1:
                some = score[fresh].argmax(1)[:, None]
            else:
                some = np.argpartition(score[fresh], -self.k, axis=1)[:, -self.k :]
            dist = blocks.paired(asked, given, np.repeat(fresh, self.k), some.ravel(), metric)
            reach[fresh] = dist.reshape(-1, self.k).max(1)
        least = limit(rows, reach * (1 + 1e-12) + 2 * 10.0**-blocks.PRECISION)
        if score.dtype == np.float32:
            with np.errstate(over="ignore"):
                least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
        else:
            least = np.maximum(least, np.iinfo(score.dtype).min).astype(score.dtype)
        near = np.flatnonzero(top >= least)
        if not len(near):
            return
        hit = score[near] >= least[near, None]
        many = np.flatnonzero(hit.sum(1) > max(CROWD, hit.shape[1] // CROWD))
        if len(many):
            rough, error = blocks.screen(asked[near[many]], given, metric)
            bound = reach[near[many]]
            hit[many] &= blocks.candidates(rough, bound**2 if metric.startswith("euclidean") else bound, error, metric)
        i, cols = np.divmod(np.flatnonzero(hit), hit.shape[1])
        self.waiting[metric].append((near[i] + rows.start, cols))

    def _settle(self, metric: str, g: blocks.Block, given: np.ndarray) -> None:
        """Measure the waiting pairs exactly and keep the k best of each query."""
        if not self.waiting[metric]:
            return
        rows, cols = (np.concatenate(c) for c in zip(*self.waiting[metric]))
        self.waiting[metric] = []
        asked = self.raw if self._sides(metric) == "raw" else self.unit
        dist = blocks.paired(asked, given, rows, cols, metric)
        within = np.flatnonzero(dist <= self.reach[metric][rows])
        new = [rows[within], g.ids[cols[within]], g.labels[cols[within]], dist[within]]
        if self.best[metric] is not None:
            new = [np.concatenate((a, b)) for a, b in zip(self.best[metric], new)]
        by = np.lexsort((new[1], new[3], new[0]))
        new = [c[by] for c in new]
        place = _places(new[0])
        self.best[metric] = [c[place < self.k] for c in new]
        last = np.flatnonzero(place == self.k - 1)
        self.reach[metric][new[0][last]] = new[3][last]


def _first(matrix: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows but those behind k equal vectors of smaller ids, which are nobody's neighbours: one vector may be very common."""
    whole = np.ascontiguousarray(matrix).view(np.dtype((np.void, matrix.shape[1] * matrix.itemsize))).ravel()
    of = np.unique(whole, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, of))
    return np.sort(order[_places(of[order]) < k])


def _places(rows: np.ndarray) -> np.ndarray:
    """Position of each row among equal ones, which lie together."""
    return np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
