"""Class centroids as mergeable sums."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotline.functions.vectors import as_double, unit


def class_sums(rows: DataFrame) -> DataFrame:
    """State per class: ``n`` and the summed vector. Rows are combined before the shuffle."""
    return (
        rows.groupBy("species")
        .agg(F.count(F.lit(1)).alias("n"), Summarizer.sum(array_to_vector("vec")).alias("_sum"))
        .select("species", "n", vector_to_array("_sum").alias("total"))
    )


def merge_sums(*states: DataFrame) -> DataFrame:
    """Add several states: new classes appear, known ones grow, the rest is untouched."""
    stacked = states[0]
    for state in states[1:]:
        stacked = stacked.unionByName(state)
    return (
        stacked.groupBy("species")
        .agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("total")).alias("_sum"))
        .select("species", "n", vector_to_array("_sum").alias("total"))
    )


def as_gallery(sums: DataFrame, renormalise: bool) -> DataFrame:
    """Centroids from sums, shaped as a gallery whose id is the class."""
    mean = F.transform("total", lambda x: x / F.col("n"))
    vec = unit(mean) if renormalise else mean
    return sums.select(F.col("species").alias("item_id"), "species", "n", vec.alias("vec"))


def normalised(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vec", unit(as_double(F.col("vec"))))


def centroids(rows: DataFrame, renormalise: bool = True, gallery_only: bool = True) -> DataFrame:
    """Class centroids of L2-normalised rows.

    ``renormalise`` gives unit centroids for cosine search; without it the plain
    mean is kept for Euclidean search. ``gallery_only`` restricts the input to the
    gallery split (evaluation); production catalogues use every row.
    """
    if gallery_only:
        rows = rows.where(F.col("split") == "gallery")
    return as_gallery(class_sums(normalised(rows)), renormalise)
