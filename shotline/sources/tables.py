"""Readers with explicit schemas and the sinks for results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX_SCHEMA = T.StructType(
    [
        T.StructField("filepath", T.StringType()),
        T.StructField("species", T.StringType()),
        T.StructField("genus", T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("ivc_score", T.IntegerType()),
        T.StructField("ivc_category", T.StringType()),
    ]
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with header and a fixed schema. A byte-order mark before the header is ignored."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def read_images(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Paths and sizes of files below a folder; the contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(folder)
        .select("path", "length", "modificationTime")
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_long_arrays(distances: DataFrame, path: str) -> None:
    """Distances of all models and metrics, one folder per pair for pruned reads."""
    distances.write.mode("overwrite").partitionBy("model", "metric").parquet(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Append predictions, one folder per model and classifier."""
    predictions.write.mode("append").partitionBy("model", "classifier").parquet(path)


def threshold_documents(thresholds: DataFrame, by: list[str]) -> DataFrame:
    """One JSON text per group: its thresholds with statistics, ordered by percentile."""
    stats = F.struct("percentile", "threshold", "coverage", "inter_contamination", "separation_gap")
    ordered = F.array_sort(F.collect_list(stats))
    return thresholds.groupBy(*by).agg(F.to_json(F.struct(ordered.alias("per_percentile_stats"))).alias("document"))


THRESHOLD_DOCUMENT = (
    "per_percentile_stats array<struct<percentile string, threshold double, coverage double, "
    "inter_contamination double, separation_gap double>>"
)


def read_threshold_documents(documents: DataFrame, by: list[str]) -> DataFrame:
    parsed = documents.select(*by, F.from_json("document", THRESHOLD_DOCUMENT).alias("d"))
    return parsed.select(*by, F.inline("d.per_percentile_stats"))


def markdown_rows(df: DataFrame) -> DataFrame:
    """Each row as a line of a Markdown table, with nulls left empty."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_header(names: list[str]) -> list[str]:
    return ["| " + " | ".join(names) + " |", "|" + "|".join(["---"] * len(names)) + "|"]


def write_markdown(df: DataFrame, path: str) -> None:
    """Header and ordered lines as text; meant for small report tables."""
    spark, names = df.sparkSession, df.columns
    head = spark.range(1).select(F.posexplode(F.array(*[F.lit(h) for h in markdown_header(names)])).alias("_o", "line"))
    body = markdown_rows(df).select(F.lit(2).alias("_o"), "line")
    head.unionByName(body).orderBy("_o").select("line").write.mode("overwrite").text(path)
