"""Exact k-nearest search for galleries too large to broadcast: pivots, rings and the triangle inequality.

A bounded sample of gallery rows serves as pivots. Each side is cut into blocks of rows that share
their nearest pivot and lie at a similar distance from it. For a block of queries the smallest
and the largest distance to every pivot are known, for a block of gallery rows the smallest and the
largest distance to its own. Their gap bounds the distance of any two rows from below:

* first, each block of queries meets the gallery blocks that must hold k rows near it;
* the largest k-th distance found in it is the block's reach; of the other gallery blocks only those
  whose lower bound is within reach are met.

A task streams gallery rows past one block of queries and keeps the k best of each, so a query
is sent once for each run of ``RUN`` gallery blocks it has to see. The sample decides only where blocks are cut: results
are exact for any pivots. Data without structure prunes little; then all blocks meet.

Cosine distances are bounded by chords of the unit vectors; zero vectors, which have none, are
blocks of their own that are never left out. Ties go to the smaller gallery id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotline.functions import blocks
from shotline.session import lookup, materialize, side_by_side

PIVOTS = 32
RINGS = 256
RUN = 64  # gallery blocks in a task
TASKS = 2_048  # partitions that runs are dealt over, at most
PIECE = 4_096  # gallery rows compared together
METRICS = ("euclidean", "euclidean_l2norm", "cosine", "manhattan")
FAR = float("inf")


def _distances(matrix: np.ndarray, pivots: np.ndarray, metric: str) -> np.ndarray:
    x = blocks.prepared(matrix, metric, True)
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.abs(x - p).sum(1) if metric == "manhattan" else np.sqrt(((x - p) ** 2).sum(1))
    return out


def _placed(side: DataFrame, pivots: np.ndarray, metric: str, shared) -> DataFrame:
    """With ``pivot`` (the nearest one), ``near`` (its distance) and ``far`` (distances to all)."""
    names = ["item_id", "species", "vec"]
    schema = T.StructType([side.schema[c] for c in names])
    schema = schema.add("pivot", T.IntegerType()).add("near", T.DoubleType()).add("far", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = blocks.vectors(batch.column("vec"))
            far = _distances(matrix, shared.value, metric)
            pivot = far.argmin(1).astype(np.int32)
            near = far[np.arange(len(far)), pivot]
            if metric == "cosine":
                zero = ~matrix.any(1)
                pivot[zero], near[zero] = len(shared.value), 0.0
            offsets = pa.array(np.arange(len(far) + 1, dtype=np.int32) * far.shape[1])
            columns = [*(batch.column(c) for c in names), pa.array(pivot), pa.array(near)]
            lists = pa.ListArray.from_arrays(offsets, pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*columns, lists], names=[*names, "pivot", "near", "far"])

    return side.select(*names).mapInArrow(run, schema)


def _cut(side: DataFrame, block_rows: int) -> DataFrame:
    """With ``block``: rows of one pivot in a ring around it, of about ``block_rows`` rows or fewer."""
    steps = [(i + 1) / RINGS for i in range(RINGS - 1)]
    cells = side.groupBy("pivot").agg(F.percentile_approx("near", steps).alias("steps"), F.count(F.lit(1)).alias("cell"))
    ringed = side.join(F.broadcast(cells), "pivot")  # one row a pivot
    below = F.size(F.filter("steps", lambda x: x < F.col("near")))
    wanted = F.least(F.ceil(F.col("cell") / block_rows), F.lit(RINGS))
    ringed = ringed.withColumn("ring", F.floor(below * wanted / RINGS).cast("int")).drop("steps", "cell")
    sizes = ringed.groupBy("pivot", "ring").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("split"))
    split = ringed.join(F.broadcast(sizes), ["pivot", "ring"])  # at most RINGS rows a pivot
    part = F.pmod(F.xxhash64("item_id"), F.col("split"))
    return split.withColumn("block", F.concat_ws(":", "pivot", "ring", part)).drop("ring", "split")


def _bounds(queries: DataFrame, gallery: DataFrame, pivots: int) -> DataFrame:
    """(qb, gb, rows, low, high) for pairs of blocks, by an equi-join on the gallery block's pivot."""
    given = gallery.groupBy("pivot", F.col("block").alias("gb")).agg(
        F.min("near").alias("inner"), F.max("near").alias("outer"), F.count(F.lit(1)).alias("rows")
    )
    rings = lookup(given.groupBy("pivot").agg(F.collect_list(F.struct("gb", "inner", "outer", "rows")).alias("rings")))
    free = F.col("pivot") == pivots  # zero vectors: no bound
    sides = []
    for j in range(pivots):
        at = F.col("far")[j]
        sides += [F.when(free, F.lit(0.0)).otherwise(at), F.when(free, F.lit(FAR)).otherwise(at)]
    ends = [F.min(s) if n % 2 == 0 else F.max(s) for n, s in enumerate(sides)]
    spans = F.array(
        *[F.struct(F.lit(j).alias("pivot"), ends[2 * j].alias("least"), ends[2 * j + 1].alias("most")) for j in range(pivots)],
        F.struct(F.lit(pivots).alias("pivot"), F.lit(0.0).alias("least"), F.lit(FAR).alias("most")),
    )
    asked = queries.groupBy(F.col("block").alias("qb")).agg(spans.alias("spans")).select("qb", F.inline("spans"))
    met = asked.join(rings, "pivot").select("qb", "pivot", "least", "most", F.inline("rings"))
    low = F.greatest(F.lit(0.0), F.col("least") - F.col("outer"), F.col("inner") - F.col("most"))
    open_ = F.col("pivot") == pivots
    return met.select(
        "qb",
        "gb",
        "rows",
        F.when(open_, F.lit(0.0)).otherwise(low).alias("low"),
        F.when(open_, F.lit(FAR)).otherwise(F.col("most") + F.col("outer")).alias("high"),
    )


def _meet(queries: DataFrame, gallery: DataFrame, pairs: DataFrame, k: int, metric: str, schema: T.StructType) -> DataFrame:
    """The k best gallery rows of each query in its pairs of blocks; several runs of a query block are not merged."""
    order = Window.partitionBy("qb").orderBy("gb")
    runs = pairs.withColumn("run", F.floor((F.row_number().over(order) - 1) / RUN))
    runs = materialize(runs.select("qb", "gb", "run"))
    names = ["item_id", "species", "vec"]
    own = materialize(runs.select("qb", "run").distinct())
    # a number that is asked for is kept: runs are few and cost much, their bytes would put them in one task
    tasks = min(TASKS, 2 * own.count() + 1)
    asked = queries.join(lookup(own), F.col("block") == F.col("qb"))
    given = gallery.join(lookup(runs), F.col("block") == F.col("gb"))
    rows = asked.select("qb", "run", F.lit(0).alias("side"), *names)
    rows = rows.unionByName(given.select("qb", "run", F.lit(1).alias("side"), *names))
    rows = rows.repartition(tasks, "qb", "run").sortWithinPartitions("qb", "run", "side")

    def finish(q: pa.Table, best) -> pa.RecordBatch:
        picked, ids, labels, dist = best
        index = pa.array(picked, type=pa.int64())
        data = [q.column("item_id").take(index), q.column("species").take(index), ids.tolist(), labels.tolist(), dist]
        types = [out_types[c] for c in schema.names]
        data = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c, type=t) for c, t in zip(data, types)]
        return pa.RecordBatch.from_arrays(data, names=schema.names)

    text_ids = isinstance(schema["neighbour_id"].dataType, T.StringType)
    arrow = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64()}
    out_types = {f.name: arrow[f.dataType] for f in schema.fields}

    def offer(q: blocks.Block, g: pa.Table, best):
        block = blocks.by_id(blocks.block(g))
        reach = np.full(len(q), FAR)
        if best is not None:  # sorted by query and distance, k rows a query at most
            last = np.flatnonzero(np.arange(len(best[0])) - np.searchsorted(best[0], best[0], side="left") == k - 1)
            reach[best[0][last]] = best[3][last]
        found = list(blocks.top_k(q, block, k, metric, reach))
        if not found:
            return best
        cols = np.concatenate([f[1] for f in found])
        new = [np.concatenate([f[0] for f in found]), block.ids[cols], block.labels[cols], np.concatenate([f[2] for f in found])]
        if best is not None:
            new = [np.concatenate((a, b)) for a, b in zip(best, new)]
        by = np.lexsort((new[1].astype(str) if text_ids else new[1], new[3], new[0]))
        new = [c[by] for c in new]
        rank = np.arange(len(by)) - np.searchsorted(new[0], new[0], side="left")
        return [c[rank < k] for c in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, q, waiting, held, best = None, [], None, [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column("qb").to_pylist(), batch.column("run").to_pylist(), batch.column("side").to_pylist()))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for at, end in zip(cuts, cuts[1:]):
                part, key, side = batch.slice(at, end - at), keys[at][:2], keys[at][2]
                if key != now:
                    if waiting:
                        best = offer(q, pa.Table.from_batches(waiting), best)
                    if best is not None:
                        yield finish(pa.Table.from_batches(asked), best)
                    now, asked, q, waiting, held, best = key, [], None, [], 0, None
                if side == 0:
                    asked.append(part)
                    continue
                if q is None:
                    q = blocks.block(pa.Table.from_batches(asked))
                waiting.append(part)
                held += part.num_rows
                if held >= PIECE:
                    best = offer(q, pa.Table.from_batches(waiting), best)
                    waiting, held = [], 0
        if waiting:
            best = offer(q, pa.Table.from_batches(waiting), best)
        if best is not None:
            yield finish(pa.Table.from_batches(asked), best)

    return rows.mapInArrow(run, schema)


def nearest(queries: DataFrame, gallery: DataFrame, k: int, metric: str, block_rows: int) -> DataFrame:
    """item_id, species, neighbour_id, neighbour, distance, rank of the k nearest gallery rows."""
    return search(queries, gallery, k, metric, block_rows)[0]


def search(queries: DataFrame, gallery: DataFrame, k: int, metric: str, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """``nearest``, and one row (query_blocks, gallery_blocks, pairs, met) that tells how many pairs of blocks met."""
    spark = queries.sparkSession
    sample = gallery.select("item_id", "vec").orderBy(F.xxhash64("item_id"), "item_id").limit(PIVOTS).toArrow()
    pivots = blocks.prepared(blocks.vectors(sample.column("vec")), metric, True)
    schema = T.StructType(
        [
            queries.schema["item_id"],
            queries.schema["species"],
            T.StructField("neighbour_id", gallery.schema["item_id"].dataType),
            T.StructField("neighbour", gallery.schema["species"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    names = ["query_blocks", "gallery_blocks", "pairs", "met"]
    if not len(pivots):
        empty = spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
        return empty, spark.createDataFrame([(0, 0, 0, 0)], ", ".join(f"{c} long" for c in names))
    shared = spark.sparkContext.broadcast(pivots)
    q = materialize(_cut(materialize(_placed(queries, pivots, metric, shared)), block_rows))
    g = materialize(_cut(materialize(_placed(gallery, pivots, metric, shared)).drop("far"), block_rows))
    pairs = materialize(_bounds(q, g, len(pivots)))

    # the blocks that hold k rows for sure, by the largest distance they can have
    upto = Window.partitionBy("qb").orderBy("high", "gb").rowsBetween(Window.unboundedPreceding, -1)
    ranked = pairs.withColumn("before", F.coalesce(F.sum("rows").over(upto), F.lit(0)))
    ranked = materialize(ranked.withColumn("first", F.col("before") < k).drop("before"))
    near = materialize(_meet(q, g, ranked.where("first"), k, metric, schema))
    kth = near.groupBy("item_id").agg(F.max("distance").alias("kth"), F.count(F.lit(1)).alias("found"))
    seen = q.select("item_id", F.col("block").alias("qb")).join(kth, "item_id", "left")
    known = F.when(F.col("found") >= k, F.col("kth")).otherwise(F.lit(FAR))
    reach = F.col("reach")
    if metric == "cosine":  # a chord; the slack covers rounding to ten decimals
        limit = F.sqrt(2 * F.greatest(reach, F.lit(0.0)) + 1e-9) + 1e-7
    else:
        limit = reach * (1 + 1e-9) + F.col("high") * 1e-9 + 1e-7
    reaches = seen.groupBy("qb").agg(F.max(known).alias("reach"))
    rest = ranked.where("not first").join(lookup(reaches), "qb")
    rest = materialize(rest.where(F.col("low") <= limit).select("qb", "gb"))
    found = near.unionByName(_meet(q, g, rest, k, metric, schema))
    order = Window.partitionBy("item_id").orderBy("distance", "neighbour_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    kinds = [F.countDistinct("qb"), F.countDistinct("gb"), F.count(F.lit(1)), F.count_if("first")]
    report = side_by_side(
        ranked.agg(*(c.alias(name) for c, name in zip(kinds, [*names[:3], "must"]))), rest.agg(F.count(F.lit(1)).alias("may"))
    )
    return found, report.select(*names[:3], (F.col("must") + F.col("may")).alias("met"))
