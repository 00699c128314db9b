"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Settings the library is tuned for. None of them is needed for right results.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # windows and aggregates on (key, chunk) can then feed a join on the same keys
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.requireAllClusterKeysForDistribution": "false",
}


def local_session(cores: int = 8, shuffle: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """Session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shotline")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
    )
    for name, value in {**RECOMMENDED, **extra}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session may do without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = _own_folders.get(context.applicationId)
        if folder is None:
            folder = _own_folders[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='shotline-')}"
            delete_at_exit(spark, folder)
    return folder.rstrip("/")


_own_folders: dict[str, str] = {}


def delete_at_exit(spark: SparkSession, folder: str) -> None:
    """Have Spark's JVM remove a folder when it ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def materialize(df: DataFrame) -> DataFrame:
    """Store ``df`` once as Parquet in the shared folder and read it from there.

    Used where one table feeds several aggregates: later reads prune columns, know the
    table's size, and depend on no earlier task.
    """
    spark = df.sparkSession
    folder = f"{shared_root(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    delete_at_exit(spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


LOOKUP_ROWS = 100_000
LOOKUP_BYTES = 64 << 20


def lookup(df: DataFrame, limit: int = LOOKUP_ROWS) -> DataFrame:
    """Dimension side of a join, broadcast only when it is counted and measured to be small.

    A table above the row limit is never stored; counting it stops at the limit.
    A table of few but wide rows is stored and left to the optimizer.
    """
    if df.limit(limit + 1).count() > limit:
        return df
    stored = materialize(df)
    wide = [F.size(f.name).cast("long") * 8 for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    wide += [F.length(f.name).cast("long") for f in df.schema if isinstance(f.dataType, T.StringType)]
    if wide:
        size = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(0))
        if (stored.agg(F.sum(size)).first()[0] or 0) > LOOKUP_BYTES:
            return stored
    return F.broadcast(stored)


def side_by_side(*frames: DataFrame) -> DataFrame:
    """Columns of several one-row results in one row, without joining them."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
