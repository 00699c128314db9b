"""Run a streaming DataFrame over everything available and read its result."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from shotline.session import delete_at_exit, shared_root


COMPACT = 16  # batches from base to base


def shared_folder(spark: SparkSession) -> str:
    """The name of a new folder in the shared one, removed when Spark ends."""
    folder = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    delete_at_exit(spark, folder)
    return folder


def start(stream: DataFrame, folder: str, mode: str, keys: list[str] | None = None, every: int = COMPACT):
    """Start a query that stores each batch in ``folder``; a repeated batch replaces itself.

    ``append`` and ``update`` keep one sub-folder per batch, ``complete`` only the
    newest result. With ``keys`` (update mode) every ``every``-th batch also stores the newest row of
    each key so far, and the batches before the last such base are removed (see ``newest``).
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        target = f"{folder}/data/batch={0 if mode == 'complete' else batch_id}"
        batch.write.mode("overwrite").parquet(target)
        if keys and batch_id % every == every - 1:
            spark = batch.sparkSession
            newest(spark, folder, keys, stream.schema, batch_id - 1, batch_id).write.mode("overwrite").parquet(
                f"{folder}/base/upto={batch_id}"
            )
            for old in range(max(0, batch_id - 2 * every + 1), batch_id - every + 1):
                _remove(spark, f"{folder}/data/batch={old}")
            _remove(spark, f"{folder}/base/upto={batch_id - 2 * every}")

    with rocks_state(stream.sparkSession):
        return (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", f"{folder}/progress")
            .foreachBatch(store)
            .trigger(availableNow=True)
            .start()
        )


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    place, system = _place(spark, path)
    system.delete(place, True)


def newest(
    spark: SparkSession, folder: str, keys: list[str], schema: StructType, base_until: int | None = None, until: int | None = None
) -> DataFrame:
    """The newest row of each key: the last base and the batches after it.

    ``base_until`` and ``until`` leave out what a repeated batch may have stored already.
    """
    place, system = _place(spark, f"{folder}/base")
    base = -1
    if system.exists(place):
        stored = [int(f.getPath().getName().partition("=")[2]) for f in system.listStatus(place)]
        base = max((b for b in stored if base_until is None or b <= base_until), default=-1)
    numbered = StructType([*schema.fields, StructField("batch", LongType())])
    rows = spark.read.schema(numbered).option("basePath", f"{folder}/data").parquet(f"{folder}/data/*")
    rows = rows.where(F.col("batch") > base)
    if until is not None:
        rows = rows.where(F.col("batch") <= until)
    if base >= 0:
        kept = spark.read.schema(schema).parquet(f"{folder}/base/upto={base}")
        rows = rows.unionByName(kept.withColumn("batch", F.lit(base).cast("bigint")))
    others = [c for c in schema.names if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in schema.names])


def upserted(stream: DataFrame, keys: list[str], every: int = COMPACT) -> DataFrame:
    """Run an aggregation to its end in update mode: only changed rows are written, the newest of each key is read."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    start(stream, folder, "update", keys, every).awaitTermination()
    return newest(spark, folder, keys, stream.schema)


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, on disk and beyond the heap; typed state needs it."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def late_rows(query: StreamingQuery) -> int:
    """Rows a query has dropped behind its watermark, over the batches it remembers."""
    return sum(op["numRowsDroppedByWatermark"] for batch in query.recentProgress for op in batch["stateOperators"])


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    spark = stream.sparkSession
    folder = shared_folder(spark)
    start(stream, folder, mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data/*")
