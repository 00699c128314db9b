"""Exact inner-product search over norm buckets.

Vectors are sorted by length (range partitions, ties by id) and cut into buckets of
``BUCKET`` rows. A query's running k-th best score t, divided by the query's length
and the longest vector of a bucket, is the local cosine threshold of that bucket:

* above 1: no row of the bucket can enter, the bucket is left out (with all later ones);
* close to 1: coordinate pruning. A row that reaches the threshold has each coordinate,
  as a share of its length, within an interval around the query's; rows
  outside it on one of the query's largest coordinates are left out;
* otherwise: length pruning. Rows shorter than t / |query| are left out.

What remains is verified by exact integer products. Queries are broadcast in blocks of
at most ``BLOCK_BYTES``, one after the other: a block's best rows are written to the shared folder and
its broadcast is given back before the next one. Candidates are never shuffled for a query, and
each partition hands on at most k rows per query, from which the k best are taken.

Nulls and edge cases: rows whose vec_id or vector is null, or whose vector holds a
null or non-finite component, take no part; a shorter vector counts as padded with
zeros; ties go to the smaller vec_id; a row with the query's own vec_id is never its
candidate; a repeated query row is one query; a repeated candidate row is one candidate.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotline.llm.common import removed_at_exit, shared_folder, stored

BUCKET = 4_096
BLOCK_BYTES = 32 << 20
FOCUS = 4  # coordinates looked at
NARROW = 0.9  # local threshold from which coordinate pruning is tried
EXACT = 2**53


def whole_numbers(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long"))


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )
    return df.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & finite)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of all rows of a and b."""
    high = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if high < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T)


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = [np.zeros(0, object)] * queries
        self.ids = [np.zeros(0, np.int64)] * queries
        self.bound = np.full(queries, -np.inf)

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        if len(score) > 4 * self.k:  # ties of the k-th score stay in
            cut = np.partition(score, len(score) - self.k)[len(score) - self.k]
            keep = score >= cut
            score, ids = score[keep], ids[keep]
        score, ids = np.concatenate((self.score[q], score)), np.concatenate((self.ids[q], ids))
        order = np.lexsort((ids, -score.astype(float)))[: self.k] if len(score) else []
        if len(score) and float(np.abs(score.astype(float)).max()) >= EXACT:
            order = sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[: self.k]
        self.score[q], self.ids[q] = score[order], ids[order]
        if len(order) == self.k:
            self.bound[q] = float(self.score[q][-1])


def search_bucket(best: Best, q: np.ndarray, q_id: np.ndarray, q_norm: np.ndarray, p: np.ndarray, ids: np.ndarray) -> None:
    """Offer the rows ``p`` (longest first) to all queries."""
    norm = np.sqrt((p.astype(float) ** 2).sum(1))
    longest = norm[0] * (1 + 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        local = best.bound / (q_norm * longest)
    local = np.where(np.isfinite(best.bound) & (best.bound > 0), np.nan_to_num(local, posinf=np.inf), -1.0)
    alive = np.flatnonzero(local <= 1 + 1e-9)
    narrow = local[alive] >= NARROW
    unit = None
    for i in alive[narrow]:  # coordinate pruning, one query at a time
        if unit is None:
            unit = p / np.maximum(norm, 1e-12)[:, None]
        u = q[i] / q_norm[i]
        t = min(local[i], 1.0)
        keep = norm >= best.bound[i] / q_norm[i] * (1 - 1e-9)
        for f in np.argsort(-np.abs(u))[:FOCUS]:
            reach = np.sqrt(max(0.0, (1 - u[f] ** 2) * (1 - t * t))) + 1e-6
            low = u[f] * t - reach if -u[f] < t else -np.inf
            high = u[f] * t + reach if u[f] < t else np.inf
            keep &= (unit[:, f] >= low) & (unit[:, f] <= high)
        keep &= ids != q_id[i]
        if keep.any():
            best.add(i, _products(q[i : i + 1], p[keep])[0], ids[keep])
    rest = alive[~narrow]
    for at in range(0, len(rest), 256):  # length pruning, one product for a block of queries
        part = rest[at : at + 256]
        with np.errstate(divide="ignore", invalid="ignore"):
            shortest = np.where(best.bound[part] > 0, best.bound[part] / q_norm[part] * (1 - 1e-9), -np.inf)
        rows = int((norm >= shortest.min()).sum())  # a prefix: longest first
        score = _products(q[part], p[:rows])
        for j, i in enumerate(part):
            ok = (score[j] >= best.bound[i]) & (ids[:rows] != q_id[i])
            if ok.any():
                best.add(i, score[j][ok], ids[:rows][ok])


def _search(block, k: int, bucket: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_id, q = block.value
        q_norm = np.sqrt((q.astype(float) ** 2).sum(1))
        q_norm_safe = np.maximum(q_norm, 1e-12)
        best = Best(len(q), k)
        for batch in batches:
            for at in range(0, batch.num_rows, bucket):
                part = batch.slice(at, bucket)
                p = _matrix(part["v"], q.shape[1])
                wide = np.zeros((len(q), p.shape[1]), np.int64)
                wide[:, : q.shape[1]] = q
                search_bucket(best, wide, q_id, q_norm_safe, p, part["vec_id"].to_numpy())
        rows = [(int(q_id[i]), int(v), int(s)) for i in range(len(q)) for v, s in zip(best.ids[i], best.score[i])]
        columns = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"]
        )

    return run


def top_k(
    rows: DataFrame, is_query: Column, k: int = 5, block_bytes: int = BLOCK_BYTES, bucket: int = BUCKET
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query row of ``rows`` (vec_id, v).

    A repeated row (same vec_id and same vector) counts once.
    """
    spark = rows.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    ready = stored(rows.select("vec_id", "v").distinct().withColumn("norm", norm), "vectors")
    wanted = ready.where(is_query)
    count, width = wanted.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    blocks = max(1, -(-count * 8 * max(width, 1) // block_bytes))
    sorted_rows = ready.repartitionByRange(F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    if blocks > 1:
        sorted_rows = stored(sorted_rows, "vectors-by-length")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    folder = f"{shared_folder(spark)}/shotline-best-{uuid.uuid4().hex}"
    removed_at_exit(spark, folder)
    for number in range(blocks):  # one block of queries at a time is held, by the driver and by the executors
        block = wanted.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).select("vec_id", "v").toArrow()
        data = spark.sparkContext.broadcast((block["vec_id"].to_numpy(), _matrix(block["v"], max(width, 1))))
        found = sorted_rows.select("vec_id", "v").mapInArrow(_search(data, k, bucket), "query_id long, vec_id long, score long")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best.select("query_id", "rank", "vec_id", "score").write.parquet(f"{folder}/block={number}")
        data.destroy()
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(f"{folder}/block=*")
