"""Percentile thresholds and how well they separate known classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotline.operators.percentiles import exact_percentiles
from shotline.session import side_by_side

PERCENTILES = {"p90": 0.90, "p95": 0.95, "p97": 0.97, "p99": 0.99}
MIN_SUPPORT = 3


def class_support(index: DataFrame, query_split: str = "query") -> DataFrame:
    """Gallery and query counts per class, and whether the gallery is too small."""
    counts = index.groupBy("species").agg(
        F.count_if(F.col("split") == "gallery").alias("gallery_count"),
        F.count_if(F.col("split") == query_split).alias("query_count"),
    )
    return counts.withColumn("excluded", F.col("gallery_count") < MIN_SUPPORT)


def included(distances: DataFrame, excluded: DataFrame, value: str) -> DataFrame:
    """Drop excluded classes and rows without a distance."""
    return distances.join(excluded.select("species"), "species", "left_anti").where(
        F.col(value).isNotNull()
    )


def global_percentiles(distances: DataFrame, value: str, probabilities=PERCENTILES) -> DataFrame:
    return exact_percentiles(distances, [], value, probabilities)


def class_percentiles(distances: DataFrame, value: str, probabilities=PERCENTILES) -> DataFrame:
    return exact_percentiles(distances, ["species"], value, probabilities).withColumnRenamed("n", "n_query")


def long_thresholds(wide: DataFrame, keys: list[str]) -> DataFrame:
    names = [c for c in wide.columns if c in PERCENTILES]
    return wide.unpivot(keys, names, "percentile", "threshold")


def threshold_stats(
    distances: DataFrame, thresholds: DataFrame, intra: str = "d_same", inter: str = "d_other"
) -> DataFrame:
    """Coverage, contamination and separation gap for every threshold row.

    ``thresholds`` is a handful of rows (one per percentile); the distances are
    read once and all thresholds are tested in the same aggregation.
    """
    rows = thresholds.select("percentile", "threshold").collect()
    share = lambda name, t: F.avg((F.col(name) <= t).cast("double"))
    tested = distances.agg(
        *[share(intra, r["threshold"]).alias(f"c{i}") for i, r in enumerate(rows)],
        *[share(inter, r["threshold"]).alias(f"x{i}") for i, r in enumerate(rows)],
    )
    middle = exact_percentiles(distances, [], inter, {"median": 0.5}).select("median")
    joined = side_by_side(tested, middle)
    one = lambda i, r: F.struct(
        F.lit(r["percentile"]).alias("percentile"),
        F.lit(r["threshold"]).alias("threshold"),
        F.round(F.col(f"c{i}"), 6).alias("coverage"),
        F.round(F.col(f"x{i}"), 6).alias("inter_contamination"),
        F.round(F.col("median") - F.lit(r["threshold"]), 6).alias("separation_gap"),
    )
    return joined.select(F.inline(F.array(*[one(i, r) for i, r in enumerate(rows)])))


def frozen_validation(distances: DataFrame, excluded: DataFrame, threshold: float) -> DataFrame:
    """Apply a fixed threshold to held-out distances (d_centroid, d_other)."""
    flagged = distances.join(
        excluded.select("species", F.lit(True).alias("_out")), "species", "left"
    ).withColumn("_in", F.col("_out").isNull() & F.col("d_centroid").isNotNull())
    counts = flagged.agg(
        F.count_if("_in").alias("n_included"), F.count_if(~F.col("_in")).alias("n_excluded")
    )
    fixed = distances.sparkSession.range(1).select(
        F.lit("frozen").alias("percentile"), F.lit(threshold).alias("threshold")
    )
    stats = threshold_stats(flagged.where("_in"), fixed, "d_centroid", "d_other")
    return side_by_side(stats.drop("percentile"), counts)


def class_coverage(distances: DataFrame, value: str, threshold: float) -> DataFrame:
    """Share of each class under a threshold, and the class median."""
    medians = exact_percentiles(distances, ["species"], value, {"median": 0.5})
    shares = distances.groupBy("species").agg(
        F.avg((F.col(value) <= threshold).cast("double")).alias("coverage")
    )
    return shares.join(medians.select("species", "median"), "species")


def value_range(rows: DataFrame, value: str) -> tuple[float, float]:
    """Smallest and largest value; a range of one when there is only one value, or none."""
    low, high = rows.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    low = 0.0 if low is None else low
    return low, high if high is not None and high > low else low + 1.0


def histogram(rows: DataFrame, value: Column, low: float, high: float, bins: int, by: list[str]) -> DataFrame:
    """Equal-width bins; the upper edge belongs to the last bin. Empty bins are absent."""
    width = (high - low) / bins
    number = F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("int")
    inside = rows.where(value.between(low, high))
    counted = inside.withColumn("bin", number).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    return counted


def density(counts: DataFrame, low: float, high: float, bins: int, by: list[str]) -> DataFrame:
    """Counts divided by total times bin width, as a plotted density would be."""
    width = (high - low) / bins
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_t"))
    return counts.join(totals, by).select(
        *by, "bin", "n", (F.col("n") / (F.col("_t") * width)).alias("density")
    )


def calibrate(distances: DataFrame, excluded: DataFrame, variants: dict[str, str]) -> DataFrame:
    """Thresholds with their statistics for several intra-distance columns.

    ``variants`` maps a variant name to its column; the inter distance is the one
    to the nearest gallery item of another class for every variant. All
    percentiles come from one pass over the distances in long form, all shares
    from a second one.
    """
    rows = distances.join(excluded.select("species"), "species", "left_anti")
    series = {**variants, "_inter": "d_other"}
    pairs = [F.struct(F.lit(k).alias("series"), F.col(c).alias("value")) for k, c in series.items()]
    long = rows.select(F.inline(F.array(*pairs)))
    marks = exact_percentiles(long, ["series"], "value", {**PERCENTILES, "median": 0.5})
    found = {r["series"]: r for r in marks.collect()}  # one row per series
    grid = [(v, c, p, found[v][p]) for v, c in variants.items() for p in PERCENTILES]
    share = lambda name, t: F.avg((F.col(name) <= t).cast("double"))
    shares = rows.agg(
        *[share(c, t).alias(f"c{i}") for i, (_, c, _, t) in enumerate(grid)],
        *[share("d_other", t).alias(f"x{i}") for i, (_, _, _, t) in enumerate(grid)],
    )
    middle = found["_inter"]["median"]
    out = [
        F.struct(
            F.lit(v).alias("variant"),
            F.lit(p).alias("percentile"),
            F.lit(t).alias("threshold"),
            F.round(F.col(f"c{i}"), 6).alias("coverage"),
            F.round(F.col(f"x{i}"), 6).alias("inter_contamination"),
            F.round(F.lit(middle - t), 6).alias("separation_gap"),
        )
        for i, (v, _, p, t) in enumerate(grid)
    ]
    return shares.select(F.inline(F.array(*out)))
