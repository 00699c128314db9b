"""Exact k-nearest search by several metrics in one pass.

A broadcast gallery is met by the queries where they are. Otherwise queries are dealt into blocks of bounded
size, a task holds one of them and streams gallery rows past it (``finder``), so memory does not follow the
gallery and a gallery row is sent once for each block of queries. Few queries meet the gallery in several runs,
so that every core has a task. Pivots (``pruned``) prune for one metric; here all pairs are screened.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shotline.functions import blocks
from shotline.functions.finder import Finder

LEAST = 1_024  # queries that are worth a task, and a sight of the gallery, of their own
EACH = 4  # tasks for each core, where rows suffice
PIECE = 8_192  # gallery rows offered together


def nearest(queries: DataFrame, gallery, k: int, metrics: tuple[str, ...], block_rows: int) -> DataFrame:
    """item_id, species, neighbour_id, neighbour, distance, rank, metric of the k nearest rows of a ``search.Gallery``."""
    names = ["item_id", "species", "vec"]
    schema = T.StructType(
        [
            queries.schema["item_id"],
            queries.schema["species"],
            T.StructField("neighbour_id", gallery.schema["item_id"].dataType),
            T.StructField("neighbour", gallery.schema["species"].dataType),
            T.StructField("distance", T.DoubleType()),
            T.StructField("rank", T.IntegerType()),
            T.StructField("metric", T.StringType()),
        ]
    )
    target = to_arrow_schema(schema)

    def results(asked: pa.Table, finder: Finder) -> Iterator[pa.RecordBatch]:
        for metric in metrics:
            if (found := finder.found(metric)) is None:
                continue
            rows, ids, labels, dist, rank = found
            index = pa.array(rows, type=pa.int64())
            data = [
                asked.column("item_id").take(index),
                asked.column("species").take(index),
                pa.array(ids.tolist() if ids.dtype.kind in "UO" else ids, from_pandas=True),
                pa.array(labels.tolist(), type=pa.string()),
                pa.array(dist),
                pa.array(rank),
                pa.array([metric] * len(rows), type=pa.string()),
            ]
            cast = [c.cast(t) for c, t in zip(data, target.types)]
            yield from pa.table(cast, schema=target).to_batches(max_chunksize=16_384)

    if gallery.shared is not None:
        shared = gallery.shared

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    finder = Finder(blocks.block(batch), k, metrics)
                    finder.offer(shared.value)
                    yield from results(pa.Table.from_batches([batch]), finder)

        return queries.select(*names).mapInArrow(scan, schema)

    asked = queries.count()
    wanted = EACH * queries.sparkSession.sparkContext.defaultParallelism
    parts = max(1, math.ceil(asked / block_rows), min(wanted, math.ceil(asked / LEAST)))
    runs = max(1, min(math.ceil(wanted / parts), math.ceil(gallery.count / block_rows)))
    # by id and vector: ids may repeat or be null, and a block is held in memory
    deal = F.xxhash64("item_id", "vec")
    left = queries.select(*names, F.lit(0).alias("side"), F.pmod(deal, F.lit(parts)).cast("int").alias("part"))
    right = gallery.rows.select(*names, F.lit(1).alias("side"), F.pmod(deal, F.lit(runs)).cast("int").alias("run"))
    left = left.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = left.select(*names, "side", "part", "run").unionByName(right.select(*names, "side", "part", "run"))
    rows = rows.withColumn("task", F.col("part") * runs + F.col("run")).drop("part", "run")
    rows = rows.repartitionById(parts * runs, "task").sortWithinPartitions("side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, finder, waiting, count = [], None, [], 0
        for batch in batches:
            mine = batch.num_rows - int(batch.column("side").to_numpy().sum())
            if mine:
                held.append(batch.slice(0, mine))
            if mine == batch.num_rows or not held:
                continue
            if finder is None:
                finder = Finder(blocks.block(pa.Table.from_batches(held)), k, metrics)
            waiting.append(batch.slice(mine))
            count += batch.num_rows - mine
            if count >= PIECE:
                finder.offer(blocks.block(pa.Table.from_batches(waiting)))
                waiting, count = [], 0
        if waiting:
            finder.offer(blocks.block(pa.Table.from_batches(waiting)))
        if finder is not None:
            yield from results(pa.Table.from_batches(held), finder)

    found = rows.mapInArrow(run, schema)
    order = Window.partitionBy("metric", "item_id").orderBy("distance", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
