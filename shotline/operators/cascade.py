"""Votes over neighbours and the decision cascades built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotline.functions.vectors import as_double, dot, unit
from shotline.operators.search import BROADCAST_ROWS, nearest
from shotline.session import lookup

EPSILON = 1e-6


def majority_vote(near: DataFrame, ks: list[int]) -> DataFrame:
    """Uniform k-NN vote for several k at once; equal counts go to the smaller label."""
    each = near.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    counts = (
        each.where(F.col("rank") <= F.col("k"))
        .groupBy("k", "item_id", "species", "neighbour")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy("k", "item_id", "species").agg(
        F.min_by("neighbour", F.struct(-F.col("n"), "neighbour")).alias("y_pred")
    )


def weighted_vote(near: DataFrame) -> DataFrame:
    """Vote weighted by 1 / (distance + epsilon), summed per label."""
    weights = near.groupBy("item_id", "species", "neighbour").agg(
        F.round(F.sum(1.0 / (F.col("distance") + EPSILON)), 8).alias("w")
    )
    return weights.groupBy("item_id", "species").agg(
        F.min_by("neighbour", F.struct(-F.col("w"), "neighbour")).alias("y_pred"),
        F.max("w").alias("weight"),
    )


def ranked_labels(near: DataFrame, k: int) -> DataFrame:
    """Distinct neighbour labels by distance, padded to k with the last one."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "neighbour")))
    labels = near.groupBy("item_id").agg(pairs.alias("p"))
    distinct = labels.select(
        "item_id", F.array_distinct(F.transform("p", lambda x: x["neighbour"])).alias("u")
    )
    padding = F.array_repeat(F.element_at("u", -1), F.lit(k) - F.size("u"))
    return distinct.select("item_id", F.slice(F.concat("u", padding), 1, k).alias("labels"))


def candidate_array(near: DataFrame, k: int) -> DataFrame:
    """One array of (species, cosine_distance) per item, best first."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "neighbour", "distance")))
    return (
        near.where(F.col("rank") <= k)
        .groupBy("item_id", "species")
        .agg(pairs.alias("p"))
        .select(
            "item_id",
            "species",
            F.transform(
                "p",
                lambda x: F.struct(
                    x["neighbour"].alias("species"), x["distance"].alias("cosine_distance")
                ),
            ).alias("top5"),
        )
    )


def own_centroid_distance(queries: DataFrame, centroids: DataFrame) -> DataFrame:
    """Cosine distance to the centroid of the item's own class; null if there is none."""
    own = lookup(centroids.select("species", F.col("vec").alias("_c")), BROADCAST_ROWS)
    joined = queries.join(own, "species", "left")
    return joined.select(
        "item_id",
        "species",
        (1.0 - dot(unit(as_double(F.col("vec"))), F.col("_c"))).alias("d_centroid"),
    )


def three_zone(
    queries: DataFrame,
    centroids: DataFrame,
    gallery: DataFrame,
    confident: float,
    rejected: float,
    k: int = 5,
) -> DataFrame:
    """Accept by centroid, reject, or let weighted neighbours decide in between.

    The neighbour search runs only for the middle zone. The reported distance is
    always the best centroid's; a neighbour winner missing from the five best
    centroids is put in front of them with its own centroid distance.
    """
    # a winner outside the five best needs its centroid distance, found below by an equi-join
    best = candidate_array(nearest(queries, centroids, 5), 5).withColumn(
        "distance", F.element_at("top5", 1)["cosine_distance"]
    )
    zone = (
        F.when(F.col("distance") <= confident, "alta")
        .when(F.col("distance") >= rejected, "rechazado")
        .otherwise("baja")
    )
    best = best.withColumn("level", zone)
    grey = queries.join(best.where("level = 'baja'").select("item_id"), "item_id", "left_semi")
    winners = weighted_vote(nearest(grey, gallery, k)).select("item_id", F.col("y_pred").alias("winner"))
    own = grey.join(winners, "item_id").select("item_id", F.col("winner").alias("species"), "vec")
    winners = own_centroid_distance(own, centroids).select(
        "item_id", F.col("species").alias("winner"), F.round("d_centroid", 10).alias("winner_distance")
    )
    joined = best.join(winners, "item_id", "left")
    listed = F.exists("top5", lambda t: t["species"] == F.col("winner"))
    front = F.array(
        F.struct(F.col("winner").alias("species"), F.col("winner_distance").alias("cosine_distance"))
    )
    decisor = F.when(F.col("level") == "alta", "BioCLIP").when(F.col("level") == "baja", "KNN")
    return joined.select(
        "item_id",
        "species",
        F.coalesce("winner", F.element_at("top5", 1)["species"]).alias("y_pred"),
        "level",
        "distance",
        decisor.otherwise("Rechazo").alias("decisor"),
        F.when(F.col("winner").isNotNull() & ~listed, F.concat(front, "top5"))
        .otherwise(F.col("top5"))
        .alias("top5"),
    )


def two_stage(
    gate_queries: DataFrame,
    gate_gallery: DataFrame,
    queries: DataFrame,
    centroids: DataFrame,
    gate: float,
    confident: float,
) -> DataFrame:
    """Open-set gate on one model, centroid decision on another for what passes."""
    first = nearest(gate_queries, gate_gallery, 1).select(
        "item_id", F.col("distance").alias("d_gallery")
    )
    passing = first.where(F.col("d_gallery") <= gate).select("item_id")
    second = nearest(queries.join(passing, "item_id", "left_semi"), centroids, 1).select(
        "item_id", F.col("neighbour").alias("_label"), F.col("distance").alias("d_centroid")
    )
    stage2 = (
        F.when(F.col("_label").isNull(), "N/A")
        .when(F.col("d_centroid") > confident, "BAJA_CONFIANZA")
        .otherwise("ALTA_CONFIANZA")
    )
    return first.join(second, "item_id", "left").select(
        "item_id",
        "d_gallery",
        F.when(F.col("d_gallery") > gate, "RECHAZADO").otherwise("PASA").alias("stage1"),
        F.coalesce("_label", F.lit("N/A")).alias("predicted"),
        "d_centroid",
        stage2.alias("stage2"),
    )
