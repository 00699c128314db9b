"""Small numpy helpers that compare one block of queries with one block of gallery rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

EPS = float(np.finfo(float).eps)
PRECISION = 10  # decimals kept before ranking, so that equal vectors tie exactly
SLICE = 512  # query rows per matrix product, at most
CELLS = 1 << 18  # distances per matrix product, at most: fewer query rows meet a large gallery block
CACHED = 1 << 14  # distances summed together, component by component
NUMBERS = 1 << 20  # components gathered per exact re-computation, at most


@dataclass
class Block:
    """Rows of one side, sorted by id: ids, labels, vectors and optional subset flags."""

    ids: np.ndarray
    labels: np.ndarray
    matrix: np.ndarray
    subsets: np.ndarray | None = None
    scale: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.ids)


def vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 1))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def flags(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), width), dtype=bool)
    rows = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    out[rows, column.flatten().to_numpy(zero_copy_only=False)] = True
    return out


def block(table: pa.Table | pa.RecordBatch, width: int = 0) -> Block:
    names = table.schema.names
    ids = table.column("item_id").to_numpy(zero_copy_only=False)
    if ids.dtype == object:
        ids = ids.astype(str)
    labels = table.column("species").to_numpy(zero_copy_only=False)
    return Block(
        ids,
        labels,
        vectors(table.column("vec")),
        flags(table.column("subsets"), width) if width else None,
        table.column("scale").to_numpy(zero_copy_only=False) if "scale" in names else None,
    )


def nothing(width: int = 0) -> Block:
    """A block without rows."""
    none = np.array([], dtype=object)
    return Block(none, none, np.zeros((0, 1)), np.zeros((0, width), dtype=bool) if width else None)


def by_id(side: Block) -> Block:
    order = np.argsort(side.ids, kind="stable")
    return Block(
        side.ids[order],
        side.labels[order],
        side.matrix[order],
        None if side.subsets is None else side.subsets[order],
        None if side.scale is None else side.scale[order],
    )


def normalised(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(length > 0, length, 1.0)


def prepared(matrix: np.ndarray, metric: str, gallery: bool) -> np.ndarray:
    if metric in ("cosine", "euclidean_l2norm") or (metric == "cosine_to_mean" and not gallery):
        return normalised(matrix)
    return matrix


def screen(q: np.ndarray, g: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Values that order like the distances, and a bound of their error for each query row.

    The values of the Euclidean metrics are squared distances from a matrix product.
    Their error follows the squared lengths of the vectors, not the distance, so it
    is bounded from those; ``candidates`` leaves the decision to exact distances.
    """
    dims = q.shape[1] + 8
    if metric == "manhattan":
        total = np.zeros((len(q), len(g)))
        columns = np.ascontiguousarray(g.T)
        step = max(1, CACHED // max(1, len(g)))
        for start in range(0, len(q), step):  # few rows at a time: sums and differences stay in the cache
            sums, rows = total[start : start + step], q[start : start + step]
            gaps = np.empty_like(sums)
            for j in range(q.shape[1]):
                np.subtract(rows[:, j, None], columns[j], out=gaps)
                sums += np.abs(gaps, out=gaps)
        return total, EPS * dims * total.max(1, initial=0.0)
    q2, g2 = (q * q).sum(1), (g * g).sum(1)
    longest = g2.max(initial=0.0)
    if metric.startswith("cosine"):
        return 1.0 - q @ g.T, EPS * dims * (1.0 + np.sqrt(q2 * longest))
    squares = np.maximum(q2[:, None] + g2[None, :] - 2.0 * (q @ g.T), 0.0)
    return squares, 2 * EPS * dims * (q2 + longest)


def slack(bound: np.ndarray, error: np.ndarray, metric: str) -> np.ndarray:
    """How far from ``bound`` a screened value can be and still tie with it after rounding."""
    grain = 2 * 10.0**-PRECISION
    if metric.startswith("euclidean"):
        grain = grain * (2 * np.sqrt(np.maximum(bound + error, 0.0)) + grain)
    return 2 * error + grain


def candidates(rough: np.ndarray, bound: np.ndarray, error: np.ndarray, metric: str) -> np.ndarray:
    """Which screened values may be at or below ``bound`` (one per row)."""
    return rough <= (bound + slack(bound, error, metric))[:, None]


def paired(q: np.ndarray, g: np.ndarray, rows: np.ndarray, cols: np.ndarray, metric: str) -> np.ndarray:
    """Exact distances of chosen pairs, rounded for ranking."""
    out = np.empty(len(rows))
    step = max(1, NUMBERS // max(1, q.shape[1]))
    for start in range(0, len(rows), step):
        part = slice(start, start + step)
        a, b = q[rows[part]], g[cols[part]]
        if metric.startswith("cosine"):
            out[part] = 1.0 - np.einsum("ij,ij->i", a, b)
        elif metric == "manhattan":
            out[part] = np.abs(a - b).sum(1)
        else:
            out[part] = np.sqrt(((a - b) ** 2).sum(1))
    return np.round(out, PRECISION)


def sliced(g: Block) -> int:
    """Query rows compared at once with the rows of ``g``."""
    return max(1, min(SLICE, CELLS // max(1, len(g))))


def top_k(q: Block, g: Block, k: int, metric: str, reach: np.ndarray | None = None):
    """Yield (query rows, gallery rows, distance, rank) of the k nearest, ties by id.

    ``g`` must be sorted by id. The matrix product only screens; everything within its
    error of the k-th value is measured again exactly. ``reach`` is the k-th distance of each query
    in rows seen before (infinite if there are fewer): where all are known, rows beyond it are left out.
    """
    if len(q) == 0 or len(g) == 0:
        return
    gm = prepared(g.matrix, metric, True)
    step = sliced(g)
    for start in range(0, len(q), step):
        qm = prepared(q.matrix[start : start + step], metric, False)
        rough, error = screen(qm, gm, metric)
        seen = None if reach is None else reach[start : start + step]
        if seen is not None and np.isfinite(seen).all():
            rows, cols = np.nonzero(candidates(rough, seen**2 if metric.startswith("euclidean") else seen, error, metric))
        elif len(g) > k:
            kth = rough.min(1) if k == 1 else np.partition(rough, k - 1, axis=1)[:, k - 1]
            rows, cols = np.nonzero(candidates(rough, kth, error, metric))
        else:
            rows, cols = np.nonzero(np.ones_like(rough, dtype=bool))
        exact = paired(qm, gm, rows, cols, metric)
        order = np.lexsort((cols, exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        first = np.searchsorted(rows, rows, side="left")
        rank = np.arange(len(rows)) - first + 1
        keep = rank <= k
        yield rows[keep] + start, cols[keep], exact[keep], rank[keep]


def same_and_other(q: Block, g: Block, metric: str):
    """Yield (start, nearest distance with equal label, nearest with another label)."""
    gm = prepared(g.matrix, metric, True)
    step = sliced(g)
    # equal labels have equal numbers; a null label equals none but null
    codes: dict = {}
    given = np.array([codes.setdefault(x, len(codes)) for x in g.labels], np.int32)
    asked = np.array([codes.get(x, -1) for x in q.labels], np.int32)
    for start in range(0, len(q), step):
        labels = asked[start : start + step]
        if len(g) == 0:
            yield start, np.full(len(labels), np.nan), np.full(len(labels), np.nan)
            continue
        qm = prepared(q.matrix[start : start + step], metric, False)
        rough, error = screen(qm, gm, metric)
        same = labels[:, None] == given[None, :]
        yield start, *(least(qm, gm, np.where(side, rough, np.inf), error, metric) for side in (same, ~same))


def least(qm: np.ndarray, gm: np.ndarray, rough: np.ndarray, error: np.ndarray, metric: str) -> np.ndarray:
    """Exact smallest distance of each row; infinite values are no candidates, a row without any gives nan."""
    bound = rough.min(1)
    rows, cols = np.nonzero(candidates(rough, bound, error, metric) & np.isfinite(rough))
    out = np.full(len(qm), np.inf)
    np.minimum.at(out, rows, paired(qm, gm, rows, cols, metric))
    return np.where(np.isinf(out), np.nan, out)


def farthest(q: Block, g: Block, metric: str):
    """Yield (query rows, gallery rows, distance) of the farthest gallery row, ties to the larger label."""
    if len(q) == 0 or len(g) == 0:
        return
    gm = prepared(g.matrix, metric, True)
    code = np.unique(g.labels.astype(str), return_inverse=True)[1]
    step = sliced(g)
    for start in range(0, len(q), step):
        qm = prepared(q.matrix[start : start + step], metric, False)
        rough, error = screen(qm, gm, metric)
        high = rough.max(1)
        rows, cols = np.nonzero(rough >= (high - slack(high, error, metric))[:, None])
        exact = paired(qm, gm, rows, cols, metric)
        order = np.lexsort((-code[cols], -exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        yield rows[first] + start, cols[first], exact[first]


def nearest_per_subset(q: Block, g: Block, metric: str):
    """Yield (query rows, subset, gallery rows, distance): nearest gallery row of each subset, ties by label."""
    if len(q) == 0 or len(g) == 0:
        return
    gm = prepared(g.matrix, metric, True)
    code = np.unique(g.labels.astype(str), return_inverse=True)[1]
    step = sliced(g)
    for start in range(0, len(q), step):
        qm = prepared(q.matrix[start : start + step], metric, False)
        rough, error = screen(qm, gm, metric)
        for s in range(q.subsets.shape[1]):
            rows = np.nonzero(q.subsets[start : start + step, s])[0]
            cols = np.nonzero(g.subsets[:, s])[0]
            if not len(rows) or not len(cols):
                continue
            part = rough[np.ix_(rows, cols)]
            i, j = np.nonzero(candidates(part, part.min(1), error[rows], metric))
            exact = paired(qm, gm, rows[i], cols[j], metric)
            order = np.lexsort((code[cols[j]], exact, i))
            i, j, exact = i[order], j[order], exact[order]
            first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
            yield rows[i[first]] + start, s, cols[j[first]], exact[first]


def worst_ratio(q: Block, g: Block):
    """Largest (scale_i + scale_j) / distance_ij over the other rows (cluster overlap)."""
    out = np.full(len(q), np.nan)
    step = sliced(g)
    for start in range(0, len(q), step):
        rows = slice(start, start + step)
        gaps, error = screen(q.matrix[rows], g.matrix, "euclidean")
        close = np.nonzero(gaps <= 1e6 * error[:, None])  # too near for the product: measured again
        gaps = np.sqrt(gaps)
        gaps[close] = paired(q.matrix[rows], g.matrix, *close, "euclidean")
        other = q.labels[rows][:, None] != g.labels[None, :]
        sums = q.scale[rows][:, None] + g.scale[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(other & (gaps > 0), sums / gaps, -np.inf)
        best = ratio.max(1) if len(g) else np.full(gaps.shape[0], -np.inf)
        out[rows] = np.where(np.isinf(best), np.nan, best)
    return out
