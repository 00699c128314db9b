"""Streaming forms of the history aggregates, de-duplication, classification and catalogue updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotline.operators import cascade, centroid, search
from shotline.session import materialize
from shotline.streaming import drain


def runs_per_day(runs: DataFrame, delay: str = "1 day") -> DataFrame:
    """Tumbling daily counts; ``ts`` must be a timestamp."""
    windows = runs.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"))
    return windows.agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("day"), "n")


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files not processed before, each once, however late it is seen again.

    The state holds one name per file ever seen, as the promise needs. The known names are
    made once, not once per batch.
    """
    fresh = files.join(materialize(known.select("filename").distinct()), "filename", "left_anti")
    return fresh.dropDuplicates(["filename"])


def live_class_sums(rows: DataFrame) -> DataFrame:
    """Growing class sums (species, n, total) of a stream of vectors, for update or complete mode.

    Each task adds its vectors before the shuffle; one row per class and task leaves it.
    """
    return centroid.class_sums(centroid.normalised(rows))


def classify_stream(
    vectors: DataFrame,
    centroids: DataFrame,
    gallery: DataFrame,
    confident: float,
    rejected: float,
    folder: str,
):
    """Start a query that runs the three-zone cascade on every micro-batch.

    Results go to ``folder``/data, one sub-folder per batch.
    """

    prepared = search.Gallery(gallery), search.Gallery(centroids)  # collected once, not once per batch

    def classify(batch: DataFrame, batch_id: int) -> None:
        out = cascade.three_zone(batch, prepared[1], prepared[0], confident, rejected)
        out.write.mode("overwrite").parquet(f"{folder}/data/batch={batch_id}")

    return (
        vectors.writeStream.option("checkpointLocation", f"{folder}/progress")
        .foreachBatch(classify)
        .trigger(availableNow=True)
        .start()
    )


def classify_all(vectors, centroids, gallery, confident, rejected) -> DataFrame:
    """Run ``classify_stream`` over everything available and read the result."""
    spark = vectors.sparkSession
    folder = drain.shared_folder(spark)
    classify_stream(vectors, centroids, gallery, confident, rejected, folder).awaitTermination()
    return spark.read.parquet(f"{folder}/data/*")
