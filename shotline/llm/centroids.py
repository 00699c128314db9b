"""Centroid clustering in whole numbers, with bounds that follow how far spheres can feel a move.

Every vector carries its cluster, an upper bound of the distance to its own centroid and a
lower bound of the distance to every other one. After the centroids have moved:

* the upper bound grows by the own centroid's drift;
* the lower bound falls by the most that any other centroid's move can have shortened the
  distance to a point of the cluster's sphere (old centroid, largest upper bound). In the
  plane through the move and the sphere's centre, no point seen from the middle of
  the move under an angle w to its direction can have come closer by more than
  drift * cos w, so the tangent to the sphere bounds all its members at once. That is less than the
  full drift unless the sphere reaches the line of the move, and negative for moves away;
* half the distance to the nearest other centroid is a lower bound too.

A vector whose upper bound stays below its lower bound keeps its cluster. For the others the
distance to the own centroid is measured, and those still ambiguous are compared
with all centroids exactly (ties: smaller number). Distances, sums and means are whole numbers.

Each round is one pass over the vectors, stored as Parquet in the shared folder, so that a lost
executor repeats tasks of one round only. Sums of a round come from the vectors that changed
their cluster, reduced to one row per cluster and component before they reach the
driver, which holds centroids, radii and sums (their number and width are parameters).

Nulls and edge cases: a vector that is null, has another number of components or holds a null or
non-finite one takes no part; a row without vec_id is clustered but never a first centroid;
repeated rows are each a vector (equal hashes: smaller components first); fewer vectors than
centroids give as many centroids as vectors; without a vec_id there is no centroid and no row;
centroids may be equal, the smaller number then takes the vectors; components beyond the
range of long become its ends, so do distances; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotline.llm.common import sliced, stored

CENTROIDS, ROUNDS, DIMS, FACTOR = 16, 3, 64, 64
ROWS = 4_096  # vectors compared at a time
PAD = 1e-9  # what bounds give away to rounding
MOST = 2**63 - 1
STATE = "vec_id long, v array<long>, cluster int, was int, upper double, lower double, scans int, distance long"


def whole_vectors(df: DataFrame, vector: str = "embedding", dims: int = DIMS, factor: int = FACTOR) -> DataFrame:
    """(vec_id, v): floor(factor * x) of each component of the vectors that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long"))
    return df.where((F.size(vector) == dims) & finite).select("vec_id", whole.alias("v"))


def first_centroids(rows: DataFrame, number: int = CENTROIDS) -> np.ndarray:
    """The vectors of the smallest hashes of ``1:<vec_id>``, one row each."""
    drawn = rows.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    found = drawn.orderBy("h", "v").limit(number).collect()
    return np.array([r.v for r in found], np.int64).reshape(len(found), len(found[0].v) if found else 0)


def distances(p: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of p and c."""
    high = max(float(np.abs(p.astype(float)).max(initial=0)), float(np.abs(c.astype(float)).max(initial=0)))
    if 4 * high * high * max(1, p.shape[1]) < 2**52:
        a, b = p.astype(float), c.astype(float)
        return ((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    a, b = p.astype(object), c.astype(object)
    return np.stack([((a - row) ** 2).sum(1) for row in b], 1)


def own_distances(p: np.ndarray, c: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of p to its own centroid."""
    high = max(float(np.abs(p.astype(float)).max(initial=0)), float(np.abs(c.astype(float)).max(initial=0)))
    wide = 4 * high * high * max(1, p.shape[1]) >= 2**62
    kind = object if wide else np.int64
    return ((p.astype(kind) - c[own].astype(kind)) ** 2).sum(1)


def shortening(c: np.ndarray, radius: float, start: np.ndarray, end: np.ndarray) -> float:
    """The most by which a point within ``radius`` of ``c`` can have come closer to a centroid that went from ``start`` to ``end``."""
    move = end - start
    drift = float(np.sqrt(move @ move))
    if drift == 0:
        return 0.0
    seen = c - (start + end) / 2  # the sphere's centre from the middle of the move
    far = float(np.sqrt(seen @ seen))
    if far <= radius * (1 + PAD):
        return drift
    angle = np.arccos(np.clip(seen @ move / (far * drift), -1, 1)) - np.arcsin(min(1.0, radius / far))
    cosine = float(np.cos(max(0.0, angle)))
    if cosine < 0:  # moves away from the whole sphere: least felt at its nearest point
        near = far - radius
        cosine *= near / np.hypot(near, drift / 2)
    return drift * cosine


@dataclass(frozen=True)
class Move:
    """What a pass needs: new centroids and, per cluster, how bounds change. No ``drift``: the first pass."""

    c: np.ndarray
    drift: np.ndarray | None = None
    loosen: np.ndarray | None = None
    half: np.ndarray | None = None

    @classmethod
    def between(cls, old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> Move:
        a, b = old.astype(float), new.astype(float)
        k = len(a)
        drift = np.sqrt(((a - b) ** 2).sum(1))
        loosen = np.zeros(k)
        half = np.full(k, np.inf)
        for i in range(k):
            others = [j for j in range(k) if j != i]
            if others:
                worst = max(shortening(a[i], radius[i], a[j], b[j]) for j in others)
                loosen[i] = worst + PAD * (abs(worst) + float(drift[others].max()))
                half[i] = np.sqrt(((b[others] - b[i]) ** 2).sum(1)).min() / 2 * (1 - PAD)
        return cls(new, drift * (1 + PAD), loosen, half)


def reassign(move: Move, p: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """Clusters and bounds for the moved centroids, and which rows were compared with all of them."""
    own, n, k = own.copy(), len(p), len(move.c)
    if move.drift is None:
        unsure = np.arange(n)
        upper, lower = np.zeros(n), np.zeros(n)
    else:
        upper = (upper + move.drift[own]) * (1 + PAD)
        lower = lower - move.loosen[own]
        lower = np.where(np.isfinite(lower), lower - PAD * np.abs(lower), lower)
        bound = np.maximum(lower, move.half[own])
        unsure = np.flatnonzero(upper >= bound)
        exact = own_distances(p[unsure], move.c, own[unsure]).astype(float)
        upper[unsure] = np.sqrt(exact) * (1 + PAD)
        unsure = unsure[upper[unsure] >= bound[unsure]]
    if len(unsure):
        d = distances(p[unsure], move.c)
        best = np.array([min(range(k), key=row.__getitem__) for row in d]) if d.dtype == object else d.argmin(1)
        own[unsure] = best
        order = np.sort(d.astype(float), 1)
        upper[unsure] = np.sqrt(order[:, 0]) * (1 + PAD)
        lower[unsure] = np.sqrt(order[:, 1]) * (1 - PAD) if k > 1 else np.inf
    return own, upper, lower, unsure


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _pass(move: Move, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in STATE.split(", ")]
        for batch in batches:
            columns = [batch[c] for c in batch.schema.names]
            for part in sliced(iter([tuple(columns)]), ROWS):
                row = dict(zip(batch.schema.names, part))
                p = _matrix(row["v"], move.c.shape[1])
                n = len(p)
                first = "cluster" not in row
                was = np.full(n, -1, np.int32) if first else row["cluster"].to_numpy()
                upper, lower = (None, None) if first else (row["upper"].to_numpy(), row["lower"].to_numpy())
                own, upper, lower, scanned = reassign(move, p, np.maximum(was, 0), upper, lower)
                scans = np.zeros(n, np.int32) if first else row["scans"].to_numpy().copy()
                scans[scanned] += 1
                exact = own_distances(p, move.c, own) if last else np.zeros(n, np.int64)
                if exact.dtype == object:
                    exact = np.array([min(MOST, d) for d in exact], np.int64)
                new = [row["vec_id"], row["v"], *map(pa.array, (own.astype(np.int32), was, upper, lower, scans, exact))]
                yield pa.RecordBatch.from_arrays(new, names=names)

    return run


def _sums(k: int, dims: int):
    """(cluster, place, high, low) of the moved vectors, place -1 for their number; two halves so that no sum leaves long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, k, dims + 1), np.int64)
        for batch in batches:
            p = np.concatenate((_matrix(batch["v"], dims), np.ones((batch.num_rows, 1), np.int64)), 1)
            for column, sign in (("cluster", 1), ("was", -1)):
                where = batch[column].to_numpy()
                real = where >= 0
                for half, part in enumerate((p >> 32, p & 0xFFFFFFFF)):
                    np.add.at(total[half], where[real], sign * part[real])
        c, place = np.divmod(np.arange(k * (dims + 1)), dims + 1)
        arrays = [c.astype(np.int32), np.where(place == dims, -1, place).astype(np.int32), *total.reshape(2, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["cluster", "place", "high", "low"])

    return run


def _add(sums: list[list[int]], counts: list[int], state: DataFrame, dims: int) -> None:
    """Bring sums and counts up to date with the vectors that changed their cluster."""
    moved = state.where("cluster <> was").select("cluster", "was", "v")
    parts = moved.mapInArrow(_sums(len(sums), dims), "cluster int, place int, high long, low long")
    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    for r in parts.groupBy("cluster", "place").agg(*whole).collect():
        value = (int(r.high) << 32) + int(r.low)
        if r.place < 0:
            counts[r.cluster] += value
        else:
            sums[r.cluster][r.place] += value


@dataclass(frozen=True)
class Clustering:
    """``rows``: vec_id, v, cluster, distance (squared), scans (passes that compared it with all centroids)."""

    rows: DataFrame
    centroids: list[list[int]]


def cluster(rows: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> Clustering:
    """``rounds`` of assigning and averaging, then a last assignment; ``rows`` (vec_id, v)."""
    k, dims = first.shape
    c = first
    state = rows
    sums, counts = [[0] * dims for _ in range(k)], [0] * k
    move = Move(c)
    for turn in range(rounds + 1):
        state = stored(state.mapInArrow(_pass(move, turn == rounds), STATE), f"clusters-{turn}")
        if turn == rounds:
            break
        _add(sums, counts, state, dims)
        radius = np.zeros(k)
        for r in state.groupBy("cluster").agg(F.max("upper").alias("r")).collect():
            radius[r.cluster] = r.r
        new = np.array([[s // n for s in of] if n else list(map(int, old)) for of, n, old in zip(sums, counts, c)], np.int64)
        move, c = Move.between(c, new, radius), new
    return Clustering(state.select("vec_id", "v", "cluster", "distance", "scans"), [list(map(int, row)) for row in c])


def report(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Cluster and squared distance of every vector, with its cluster's inertia and centroid digest and the inertia of all."""
    rows = whole_vectors(df, vector)
    first = first_centroids(rows)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scans int"
    if not len(first):
        return df.sparkSession.createDataFrame([], out)
    found = cluster(rows, first)
    total = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    inertia = {r.cluster: int(r.total) for r in found.rows.groupBy("cluster").agg(total).collect()}
    whole = min(MOST, sum(inertia.values()))
    known = [
        (i, min(MOST, inertia.get(i, 0)), whole, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for i, c in enumerate(found.centroids)
    ]
    names = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    sides = F.broadcast(df.sparkSession.createDataFrame(known, names))  # one row per centroid
    columns = [f.split()[0] for f in out.split(", ")]
    return found.rows.join(sides, "cluster").select(*columns)
