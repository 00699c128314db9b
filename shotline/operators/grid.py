"""Classifier grid with stored predictions: a restart runs only what is missing.

The store is a folder of Parquet files, one partition per (model, classifier). Each pair is
written by one job that replaces its own partition only when it commits, so a
run that breaks off leaves the finished pairs and nothing half done. A pair counts as finished
when its partition holds as many items as there are to predict; pairs of an older, smaller
catalogue are thus run again. Summaries are aggregations over the store.
"""

from __future__ import annotations

import time

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotline.operators import metrics
from shotline.operators.classifiers import REGISTRY, Classifier, evaluate, sharing
from shotline.session import materialize, side_by_side

PAIR = ["model", "classifier"]


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _replace(df: DataFrame, path: str) -> None:
    """Replace the partitions of ``df`` and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PAIR).parquet(path)


def predictions(spark: SparkSession, path: str, item_type: str = "bigint") -> DataFrame:
    """Stored predictions: item_id, y_true, y_pred, top, model, classifier."""
    schema = f"item_id {item_type}, y_true string, y_pred string, top array<string>, model string, classifier string"
    if not _exists(spark, f"{path}/predictions"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/predictions")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """What each stored pair took: seconds, items, model, classifier."""
    return spark.read.schema("seconds double, items bigint, model string, classifier string").parquet(f"{path}/runs")


def finished(spark: SparkSession, path: str, items: dict[str, int]) -> set[tuple[str, str]]:
    """Pairs whose stored items are as many as the model has to predict."""
    counted = predictions(spark, path).groupBy(*PAIR).count().collect()  # one row per pair
    return {(r["model"], r["classifier"]) for r in counted if r["count"] == items.get(r["model"])}


class GridError(RuntimeError):
    """Pairs that failed; the others are stored and a restart runs only these."""


def run_grid(
    models: dict[str, DataFrame],
    path: str,
    names: list[str] | None = None,
    force: bool = False,
    own: dict[str, Classifier] | None = None,
) -> list[tuple[str, str]]:
    """Predict the held-out rows of each model by each classifier and store them; returns the pairs run.

    ``models`` maps a name to its rows (item_id, species, split, vec). A pair that fails does
    not keep the others from running.
    """
    known = {**REGISTRY, **(own or {})}
    names = list(known) if names is None else names
    ran, failed = [], []
    for model, rows in models.items():
        spark = rows.sparkSession
        held = rows.where(F.col("split") != "gallery").count()
        kind = rows.schema["item_id"].dataType.simpleString()
        done = set() if force else finished(spark, path, {model: held})
        wanted = [name for name in names if (model, name) not in done]
        of_model = sharing({name: known[name] for name in wanted if name in known})
        for name in wanted:
            start = time.perf_counter()
            try:
                found = evaluate(rows, model, [name], own=of_model, top=True)
                found = found.select(F.col("item_id").cast(kind), "y_true", "y_pred", "top", *PAIR)
                _replace(found, f"{path}/predictions")
            except PySparkException as error:
                failed.append(f"{model} / {name}: {str(error)[:300]}")
                continue
            took = [(time.perf_counter() - start, held, model, name)]
            _replace(spark.createDataFrame(took, "seconds double, items bigint, model string, classifier string"), f"{path}/runs")
            ran.append((model, name))
    if failed:
        raise GridError("; ".join(failed))
    return ran


def summary(stored: DataFrame) -> DataFrame:
    """Accuracy, Top-5 accuracy and macro scores of each stored pair."""
    cells = materialize(metrics.confusion(stored, PAIR))
    hit = F.array_contains("top", F.col("y_true")).cast("double")
    top = stored.groupBy(*PAIR).agg(F.avg(hit).alias("top5"))
    scores = metrics.macro_scores(cells, PAIR).drop("n_labels")
    return metrics.accuracy(cells, PAIR).join(top, PAIR).join(scores, PAIR)


def latency(spark: SparkSession, path: str) -> DataFrame:
    """Milliseconds per item of each stored pair, training and writing included."""
    return runs(spark, path).select(*PAIR, (F.col("seconds") * 1000 / F.col("items")).alias("ms_per_item"))


def space_metrics(models: dict[str, DataFrame]) -> DataFrame:
    """How well each model's space separates the classes: dim, silhouette, Davies-Bouldin, Calinski-Harabasz."""
    out = None
    for model, rows in models.items():
        dim = rows.agg(F.max(F.size("vec")).cast("bigint").alias("dim"))
        parts = (dim, metrics.silhouette(rows), metrics.davies_bouldin(rows), metrics.calinski_harabasz(rows))
        row = side_by_side(*parts).select(F.lit(model).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out
