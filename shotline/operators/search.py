"""Exact nearest-neighbour search between two sets of vectors.

Both sides carry ``item_id``, ``species`` and ``vec``. Two physical plans give
the same answer:

* a gallery proven small (row and byte limits are checked) is broadcast once and
  the queries are scanned without any shuffle;
* otherwise ``pruned`` cuts both sides around pivots and leaves out pairs of blocks that the triangle
  inequality rules out; searches other than ``nearest`` hash both sides into blocks, each pair of blocks
  becomes one bounded task, and only the best rows of a pair of blocks leave it. ``nearest`` by several
metrics at once is ``together``.

Distances are rounded to ten decimals before ranking and ties go to the smaller
gallery id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shotline.functions import blocks
from shotline.operators import pruned, together

BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 128 << 20
BLOCK_ROWS = 16_384

# (queries, gallery) -> columns of the result, as an Arrow table
Kernel = Callable[[pa.RecordBatch, blocks.Block, blocks.Block], pa.Table]


def _side(df: DataFrame, extra: list[str]) -> DataFrame:
    # fresh column identities: both sides may come from the same table
    return df.select(*[F.col(c).alias(c) for c in ("item_id", "species", "vec", *extra)])


class Gallery:
    """A gallery whose size is checked once: small ones are kept as a broadcast block.

    Rows are counted and their bytes summed before any vector reaches the driver. Pass
    it in place of a DataFrame to search the same gallery again and again.
    """

    def __init__(
        self,
        df: DataFrame,
        extra: tuple[str, ...] = (),
        width: int = 0,
        broadcast_rows: int = BROADCAST_ROWS,
    ):
        self.df, self.schema = df, df.schema
        self.rows = _side(df, list(extra) + (["subsets"] if width else []))
        self.shared = None
        size = F.coalesce(F.sum(F.size("vec").cast("long") * 8), F.lit(0))
        self.count, self.bytes = self.rows.agg(F.count(F.lit(1)), size).first()
        if self.count <= broadcast_rows and self.bytes <= BROADCAST_BYTES:
            block = blocks.by_id(blocks.block(self.rows.toArrow(), width))
            self.shared = df.sparkSession.sparkContext.broadcast(block)

    def select(self, *columns) -> DataFrame:
        return self.df.select(*columns)


def compare(
    queries: DataFrame,
    gallery: DataFrame | Gallery,
    kernel: Kernel,
    added: list[T.StructField],
    width: int = 0,
    extra: tuple[str, ...] = (),
    broadcast_rows: int = BROADCAST_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, bool]:
    """Run ``kernel`` for all queries against the gallery; True if one pass saw it all."""
    names = list(extra) + (["subsets"] if width else [])
    if not isinstance(gallery, Gallery):
        gallery = Gallery(gallery, extra, width, broadcast_rows)
    q, g = _side(queries, names), gallery.rows
    schema = T.StructType([q.schema["item_id"], q.schema["species"], *added])
    if gallery.shared is not None:
        shared = gallery.shared

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    out = kernel(batch, blocks.block(batch, width), shared.value)
                    yield from out.to_batches()

        return q.mapInArrow(scan, schema), True

    q_blocks = max(1, math.ceil(queries.count() / block_rows))
    g_blocks = max(1, math.ceil(gallery.count / block_rows))
    left = q.withColumn("_qb", F.pmod(F.xxhash64("item_id"), F.lit(q_blocks))).withColumn(
        "_gb", F.explode(F.sequence(F.lit(0), F.lit(g_blocks - 1)))
    )
    right = g.withColumn("_gb", F.pmod(F.xxhash64("item_id"), F.lit(g_blocks)).cast("int")).withColumn(
        "_qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q_blocks - 1).cast("bigint")))
    )

    def pair(left_rows: pa.Table, right_rows: pa.Table) -> pa.Table:
        batch = left_rows.combine_chunks()
        if batch.num_rows == 0:
            return target.empty_table()
        found = blocks.block(right_rows, width) if right_rows.num_rows else blocks.nothing(width)
        return kernel(batch, blocks.block(batch, width), blocks.by_id(found))

    target = to_arrow_schema(schema)
    joined = left.groupBy("_qb", "_gb").cogroup(right.groupBy("_qb", "_gb"))
    return joined.applyInArrow(pair, schema), False


def _rows(batch, picked: np.ndarray, **columns) -> pa.Table:
    index = pa.array(picked, type=pa.int64())
    data = {
        "item_id": batch.column("item_id").take(index),
        "species": batch.column("species").take(index),
        **columns,
    }
    return pa.table(data)


def _join(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.array([], dtype=dtype)


def nearest(
    queries: DataFrame, gallery: DataFrame | Gallery, k: int, metric: str | tuple[str, ...] = "cosine", **sizes
) -> DataFrame:
    """The k nearest gallery rows of every query.

    Result: item_id, species (of the query), neighbour_id, neighbour (its
    species), distance, rank. Several metrics are searched in one pass; their rows have ``metric`` too.
    """
    if not isinstance(metric, str):
        if unknown := set(metric) - set(pruned.METRICS):
            raise ValueError(f"unknown metrics {sorted(unknown)}")
        if not isinstance(gallery, Gallery):
            gallery = Gallery(gallery, broadcast_rows=sizes.get("broadcast_rows", BROADCAST_ROWS))
        return together.nearest(queries, gallery, k, tuple(metric), sizes.get("block_rows", BLOCK_ROWS))
    if metric in pruned.METRICS:
        if not isinstance(gallery, Gallery):
            gallery = Gallery(gallery, broadcast_rows=sizes.get("broadcast_rows", BROADCAST_ROWS))
        if gallery.shared is None:
            return pruned.nearest(queries, gallery.rows, k, metric, sizes.get("block_rows", BLOCK_ROWS))
    id_type = gallery.schema["item_id"].dataType
    text_ids = isinstance(id_type, T.StringType)
    added = [
        T.StructField("neighbour_id", id_type),
        T.StructField("neighbour", gallery.schema["species"].dataType),
        T.StructField("distance", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
    ]

    def kernel(batch, q: blocks.Block, g: blocks.Block) -> pa.Table:
        found = list(blocks.top_k(q, g, k, metric))
        cols = _join([f[1] for f in found], int)
        ids = g.ids[cols]
        return _rows(
            batch,
            _join([f[0] for f in found], int),
            neighbour_id=pa.array(ids.tolist() if text_ids else ids),
            neighbour=pa.array(g.labels[cols].tolist(), type=pa.string()),
            distance=pa.array(_join([f[2] for f in found], float)),
            rank=pa.array(_join([f[3] for f in found], int).astype(np.int32)),
        )

    out, complete = compare(queries, gallery, kernel, added, **sizes)
    if complete:
        return out
    order = Window.partitionBy("item_id").orderBy("distance", "neighbour_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def farthest(queries: DataFrame, gallery: DataFrame, metric: str = "cosine", **sizes) -> DataFrame:
    """The farthest gallery row of every query: item_id, species, neighbour, distance.

    One row per query leaves each block; ties go to the larger label.
    """
    added = [
        T.StructField("neighbour", gallery.schema["species"].dataType),
        T.StructField("distance", T.DoubleType()),
    ]

    def kernel(batch, q: blocks.Block, g: blocks.Block) -> pa.Table:
        found = list(blocks.farthest(q, g, metric))
        cols = _join([f[1] for f in found], int)
        return _rows(
            batch,
            _join([f[0] for f in found], int),
            neighbour=pa.array(g.labels[cols].tolist(), type=pa.string()),
            distance=pa.array(_join([f[2] for f in found], float)),
        )

    out, complete = compare(queries, gallery, kernel, added, **sizes)
    if complete:
        return out
    best = F.max_by(F.struct("neighbour", "distance"), F.struct("distance", "neighbour"))
    return out.groupBy("item_id", "species").agg(best.alias("b")).select("item_id", "species", "b.*")


def label_minima(queries: DataFrame, gallery: DataFrame, metric: str = "cosine", **sizes) -> DataFrame:
    """Nearest distance inside the query's own class and to any other class.

    Result: item_id, species, d_same, d_other; null where there is no candidate.
    """
    added = [T.StructField("d_same", T.DoubleType()), T.StructField("d_other", T.DoubleType())]

    def kernel(batch, q: blocks.Block, g: blocks.Block) -> pa.Table:
        found = list(blocks.same_and_other(q, g, metric))
        return _rows(
            batch,
            np.arange(len(q)),
            d_same=pa.array(_join([f[1] for f in found], float), from_pandas=True),
            d_other=pa.array(_join([f[2] for f in found], float), from_pandas=True),
        )

    out, complete = compare(queries, gallery, kernel, added, **sizes)
    if complete:
        return out
    return out.groupBy("item_id", "species").agg(
        F.min("d_same").alias("d_same"), F.min("d_other").alias("d_other")
    )


def nearest_per_subset(
    queries: DataFrame, gallery: DataFrame, subsets: int, metric: str = "euclidean", **sizes
) -> DataFrame:
    """Nearest gallery row inside each numbered subset both sides belong to.

    Both sides carry ``subsets`` (array of subset numbers below ``subsets``).
    Result: item_id, species, subset, neighbour, distance.
    """
    added = [
        T.StructField("subset", T.IntegerType()),
        T.StructField("neighbour", T.StringType()),
        T.StructField("distance", T.DoubleType()),
    ]

    def kernel(batch, q: blocks.Block, g: blocks.Block) -> pa.Table:
        found = list(blocks.nearest_per_subset(q, g, metric))
        cols = _join([f[2] for f in found], int)
        numbers = [np.full(len(f[0]), f[1], dtype=np.int32) for f in found]
        return _rows(
            batch,
            _join([f[0] for f in found], int),
            subset=pa.array(_join(numbers, np.int32).astype(np.int32)),
            neighbour=pa.array(g.labels[cols].tolist(), type=pa.string()),
            distance=pa.array(_join([f[3] for f in found], float)),
        )

    out, complete = compare(queries, gallery, kernel, added, width=subsets, **sizes)
    if complete:
        return out
    best = F.min_by(F.struct("neighbour", "distance"), F.struct("distance", "neighbour"))
    return (
        out.groupBy("item_id", "species", "subset")
        .agg(best.alias("b"))
        .select("item_id", "species", "subset", "b.neighbour", "b.distance")
    )


def worst_overlap(classes: DataFrame, **sizes) -> DataFrame:
    """For each class (with ``vec`` and ``scale``) the worst overlap with another class."""
    added = [T.StructField("overlap", T.DoubleType())]

    def kernel(batch, q: blocks.Block, g: blocks.Block) -> pa.Table:
        return _rows(
            batch,
            np.arange(len(q)),
            overlap=pa.array(blocks.worst_ratio(q, g), from_pandas=True),
        )

    out, complete = compare(classes, classes, kernel, added, extra=("scale",), **sizes)
    if complete:
        return out
    return out.groupBy("item_id", "species").agg(F.max("overlap").alias("overlap"))
