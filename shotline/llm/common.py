"""Helpers shared by the training-data operators: stored tables, text batches, components.

Words are the runs of bytes other than space and 0x09-0x0D; ``bytes.split()``
cuts at exactly these six bytes, whatever the text's language.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def long_texts(df: DataFrame, rows: int = 500) -> DataFrame:
    """Lower the session's Arrow batch size to ``rows``: batches of whole texts stay small in JVM and Python.

    Results do not depend on it; a smaller setting of the caller stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key))
    if now <= 0 or now > rows:
        df.sparkSession.conf.set(key, str(rows))
    return df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; only a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='shotline-llm-')}"
    return folder


def removed_at_exit(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it from there.

    Lineage ends here: a lost executor costs the tasks it ran, not what fed the
    table. Later reads prune columns and know the table's size, so that the
    optimizer broadcasts it only when it is small. Spark's JVM removes the
    folder when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/shotline-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    removed_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 32 << 20) -> bool:
    """Whether a stored table of fixed-width columns takes at most ``most`` bytes, by its counted rows."""
    width = 16 + sum({"bigint": 8, "double": 8, "int": 4, "boolean": 1}.get(kind, 32) for _, kind in df.dtypes)
    return df.count() * width <= most


def broadcast_small(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast only if it is counted to be small.

    Above the bound the join shuffles both sides and leaves skew to the optimizer.
    """
    return F.broadcast(df) if small(df, most) else df


class Sieve:
    """A bitmap of the keys of ``rows``: it passes every row with one of them, and few others.

    A key sets one bit by its hash; 64 bits are a row of a stored table of at most ``most`` / 64 rows, which is small
    enough for broadcast whatever the input. Sixteen bits a key let one other row in 16 pass; beyond ``most`` / 16
    keys more do, so an exact join has to follow. What fails needs no shuffle.
    """

    def __init__(self, rows: DataFrame, keys: list[str], label: str, most: int = 1 << 25):
        bits = min(most, max(1_024, 1 << (16 * rows.count() - 1).bit_length()))
        self.at = F.pmod(F.xxhash64(F.lit(bits), *keys), F.lit(bits))
        words = rows.select(self.at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word"))
        self.words = stored(words.agg(F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 as int))")).alias("_set")), label)

    def _join(self, df: DataFrame, how: str) -> DataFrame:
        bit = F.expr("_set & shiftleft(1L, cast(_at & 63 as int))") != 0
        meets = (F.shiftright("_at", 6) == F.col("_word")) & bit
        return df.withColumn("_at", self.at).join(F.broadcast(self.words), meets, how).drop("_at")

    def passing(self, df: DataFrame) -> DataFrame:
        return self._join(df, "left_semi")

    def failing(self, df: DataFrame) -> DataFrame:
        return self._join(df, "left_anti")


def text_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """The values of a string column as UTF-8, one at a time and without a copy of the whole."""
    if column.type not in (pa.binary(), pa.large_binary()):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for value in column:
        yield value.as_py()


def sliced(batches: Iterator[tuple[pa.Array, ...]], rows: int = 1_000) -> Iterator[tuple[pa.Array, ...]]:
    """The same rows in smaller batches, so that results are handed on before a batch is done."""
    for columns in batches:
        for at in range(0, len(columns[0]), rows):
            yield tuple(c.slice(at, rows) for c in columns)


def text_slices(column: pa.Array, most: int = 4 << 20) -> Iterator[list[bytes | None]]:
    """Lists of consecutive texts of about ``most`` bytes; a longer text is a list of its own."""
    held: list[bytes | None] = []
    size = 0
    for value in text_bytes(column):
        held.append(value)
        size += len(value or b"")
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), root the smallest node it is linked to.

    Each round sends every node to its smallest neighbour (``m``), links its
    other neighbours to the same one, and follows one more step, so that chains
    shorten by half. Rounds are equi-joins with one unique side; a node with very
    many links is split by the adaptive skew join, since both sides are stored.
    """
    now = stored(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        label,
    )
    while True:
        smallest = stored(now.groupBy("u").agg(F.min("v").alias("m")), label)
        done = now.count() == smallest.count()
        if done and now.join(smallest.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return smallest.select(F.col("u").alias("node"), F.col("m").alias("root"))
        linked = now.join(smallest, "u").select(
            F.inline(
                F.array(
                    F.struct(F.col("u").alias("x"), F.col("m").alias("y")),
                    F.struct(F.col("v").alias("x"), F.col("m").alias("y")),
                )
            )
        )
        jumped = linked.where("x <> y").join(smallest.select(F.col("u").alias("y"), "m"), "y", "left")
        now = stored(
            jumped.select(F.col("x").alias("u"), F.coalesce("m", "y").alias("v")).where("u <> v").distinct(), label
        )
