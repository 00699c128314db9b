"""Open-set detection, scalability curves and cost of adding classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotline.operators import centroid, metrics, search
from shotline.operators.percentiles import exact_percentiles
from shotline.operators.scan import digest
from shotline.session import materialize


def outlier_threshold(gallery: DataFrame, means: DataFrame, probability: float = 0.95) -> float:
    """Percentile of the gallery's distances to the plain mean of their own class."""
    own = metrics.own_mean_distance(gallery, means)
    return exact_percentiles(own, [], "distance", {"threshold": probability}).first()["threshold"]


def known_classes(gallery: DataFrame, share: float = 0.8) -> DataFrame:
    """The first share of the sorted classes."""
    names = gallery.select("species").distinct()
    return names.orderBy("species").limit(int(names.count() * share))


def open_set(gallery: DataFrame, queries: DataFrame, share: float = 0.8) -> DataFrame:
    """Hide part of the classes and flag queries far from every known mean."""
    known = materialize(known_classes(gallery, share))
    seen = gallery.join(known, "species", "left_semi")
    means = materialize(centroid.centroids(seen, renormalise=False, gallery_only=False))
    limit = outlier_threshold(seen, means)
    near = search.nearest(centroid.normalised(queries), means, 1, metric="euclidean")
    marked = known.withColumn("_known", F.lit(1))
    rows = (
        near.join(marked, "species", "left")
        .withColumn("truth", F.when(F.col("_known").isNull(), 1).otherwise(0))
        .withColumn("threshold", F.lit(limit))
        .withColumn("guess", (F.col("distance") > limit).cast("int"))
    )
    return metrics.binary_scores(rows, "truth", "guess", ["threshold"])


def class_choices(gallery: DataFrame, steps: list[int], repeats: int, seed: int) -> DataFrame:
    """Seeded class samples: (subset, num_classes, repeat, species), and last all classes.

    Steps that reach the number of classes are replaced by the one with all of them.
    """
    names = gallery.select("species").distinct()
    total = names.count()
    variants = [(i * repeats + r, s, r) for i, s in enumerate(steps) if s < total for r in range(repeats)]
    variants.append((len(steps) * repeats, total, 0))
    grid = F.array(
        *[
            F.struct(F.lit(v).alias("subset"), F.lit(s).alias("num_classes"), F.lit(r).alias("repeat"))
            for v, s, r in variants
        ]
    )
    rows = names.select("species", F.inline(grid))
    order = Window.partitionBy("subset").orderBy(digest(seed, F.col("subset"), F.col("species")))
    picked = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.col("num_classes"))
    return picked.select("subset", "num_classes", "repeat", "species")


def scalability(
    gallery: DataFrame, queries: DataFrame, steps: list[int], repeats: int, seed: int
) -> DataFrame:
    """Accuracy and macro scores against the number of classes, all variants in one job."""
    means = materialize(centroid.centroids(gallery, renormalise=False, gallery_only=False))
    limit = outlier_threshold(gallery, means)
    choices = materialize(class_choices(gallery, steps, repeats, seed))
    flags = choices.groupBy("species").agg(F.sort_array(F.collect_list("subset")).alias("subsets"))
    found = search.nearest_per_subset(
        centroid.normalised(queries).join(flags, "species"),
        means.join(flags, "species"),
        len(steps) * repeats + 1,
    ).withColumnsRenamed({"species": "y_true", "neighbour": "y_pred"})
    cells = materialize(
        found.groupBy("subset", "y_true", "y_pred").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("distance") > limit).alias("n_out")
        )
    )
    scores = (
        metrics.accuracy(cells, ["subset"])
        .join(metrics.macro_scores(cells, ["subset"]), "subset")
        .join(cells.groupBy("subset").agg((F.sum("n_out") / F.sum("n")).alias("outlier_rate")), "subset")
        .join(choices.select("subset", "num_classes").distinct(), "subset")
    )
    return scores.groupBy("num_classes").agg(
        F.floor(F.avg("n_items")).alias("samples"),
        *[F.avg(c).alias(c) for c in ("accuracy", "f1", "precision", "recall", "outlier_rate")],
    )


def _initial(gallery: DataFrame, base: int, added: int) -> int:
    """Classes to begin with: ``base``, or fewer so that ``added`` classes are left to add."""
    names = gallery.select("species").distinct().count()
    return min(base, max(0, names - added))


def incremental_cost(
    gallery: DataFrame, item_ms: float, base: int = 10, added: int = 5, shots: int = 5
) -> DataFrame:
    """Shots and ingest time of each of the ``added`` classes that follow the first ``base`` ones."""
    counts = gallery.groupBy("species").agg(F.count(F.lit(1)).alias("n"))
    new = counts.orderBy("species").offset(_initial(gallery, base, added)).limit(added)
    used = F.least(F.lit(shots), F.col("n"))
    return new.select("species", used.alias("shots"), (used * item_ms / 1000.0).alias("seconds"))


def incremental_summary(
    gallery: DataFrame, item_ms: float, base: int = 10, added: int = 5, shots: int = 5
) -> DataFrame:
    """Classes before and added, their shots, and the ingest time in all and per added class."""
    cost = incremental_cost(gallery, item_ms, base, added, shots)
    return cost.agg(
        F.lit(_initial(gallery, base, added)).cast("bigint").alias("initial_classes"),
        F.count(F.lit(1)).alias("added_classes"),
        F.coalesce(F.sum("shots"), F.lit(0)).alias("shots"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total_seconds"),
        F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("seconds_per_class"),
    )
