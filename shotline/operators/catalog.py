"""Catalogue of items: paths, names, scores, dataset statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotline.functions.labels import normal_name, second_candidate
from shotline.operators.taxonomy import score_category
from shotline.session import lookup as small

IMAGE_TYPES = ["jpg", "jpeg", "png", "bmp"]


def image_paths(paths: DataFrame, column: str = "path", root: str = "images") -> DataFrame:
    """Image files with family, genus and species folder taken from below ``root``."""
    parts = F.filter(F.split(column, "/"), lambda x: x != "")
    at = F.array_position("_parts", F.lit(root)).cast("int")
    kept = paths.withColumn("_parts", parts).withColumn("_at", at)
    suffix = F.lower(F.regexp_extract(column, r"\.([^./]+)$", 1))
    kept = kept.where(suffix.isin(IMAGE_TYPES) & (F.col("_at") > 0) & (F.size("_parts") > F.col("_at") + 2))
    level = lambda i: F.element_at("_parts", F.col("_at") + i)
    return kept.select(
        *paths.columns, level(1).alias("family"), level(2).alias("genus"), level(3).alias("folder")
    )


def map_rows(spark, mapping: dict[str, str], names: tuple[str, str]) -> DataFrame:
    """A flat configuration map as a two-column table."""
    literal = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return spark.range(1).select(F.explode(literal).alias(*names))


def hardcoded_rows(spark, mapping: dict[str, tuple[int, str]]) -> DataFrame:
    literal = F.create_map(
        *[
            x
            for name, (score, category) in mapping.items()
            for x in (F.lit(name), F.struct(F.lit(score).alias("score"), F.lit(category).alias("category")))
        ]
    )
    return spark.range(1).select(F.explode(literal).alias("name", "fix")).select("name", "fix.*")


def name_lookup(scores: DataFrame, aliases: DataFrame, hardcoded: DataFrame) -> DataFrame:
    """Everything known about a normalised name, one row per name."""
    null = F.lit(None)
    direct = scores.select(normal_name(F.col("species")).alias("name"), F.col("score").cast("int").alias("direct"))
    direct = direct.groupBy("name").agg(F.max("direct").alias("direct"))
    aliased = aliases.join(direct.withColumnRenamed("name", "target"), "target").select(
        "name", F.col("direct").alias("aliased")
    )
    stacked = (
        direct.select("name", "direct", null.cast("int").alias("aliased"), null.cast("struct<score:int,category:string>").alias("fixed"))
        .unionByName(aliased.select("name", null.cast("int").alias("direct"), "aliased", null.cast("struct<score:int,category:string>").alias("fixed")))
        .unionByName(hardcoded.select("name", null.cast("int").alias("direct"), null.cast("int").alias("aliased"), F.struct("score", "category").alias("fixed")))
    )
    return stacked.groupBy("name").agg(
        F.max("direct").alias("direct"), F.max("aliased").alias("aliased"), F.max("fixed").alias("fixed")
    )


def with_scores(items: DataFrame, lookup: DataFrame) -> DataFrame:
    """Score, category and display name of items with ``folder`` and ``genus``.

    For the folder name and then for the genus-folder name: fixed entry, then
    alias. After both: direct match of the folder, direct match of the second
    name (which also becomes the display name), else score 0.
    """
    lookup = small(lookup)
    a = normal_name(F.col("folder"))
    named = items.withColumn("_a", a).withColumn("_b", second_candidate(a, normal_name(F.col("genus"))))
    for side in ("a", "b"):
        part = lookup.select(
            F.col("name").alias(f"_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in ("direct", "aliased", "fixed")]
        )
        named = named.join(part, f"_{side}", "left")
    fixed_a, fixed_b = F.col("fixed_a"), F.col("fixed_b")
    by_hand = F.coalesce(fixed_a["score"], F.col("aliased_a"), fixed_b["score"], F.col("aliased_b"))
    score = F.coalesce(by_hand, F.col("direct_a"), F.col("direct_b"), F.lit(0))
    explicit = F.when(fixed_a.isNotNull(), fixed_a["category"]).when(
        F.col("aliased_a").isNull() & fixed_b.isNotNull(), fixed_b["category"]
    )
    second = by_hand.isNull() & F.col("direct_a").isNull() & F.col("direct_b").isNotNull()
    shown = F.when(second, F.concat_ws(" ", "genus", "folder")).otherwise(F.col("folder"))
    return named.select(
        *items.columns,
        F.replace(shown, F.lit("_"), F.lit(" ")).alias("species"),
        score.alias("score"),
        F.coalesce(explicit, score_category(score)).alias("category"),
    )


def missing_targets(aliases: DataFrame, scores: DataFrame) -> DataFrame:
    """Aliases that point to a name without a score."""
    known = scores.select(normal_name(F.col("species")).alias("target"))
    return aliases.join(known, "target", "left_anti").select("name", "target")


def with_common_names(index: DataFrame, names: DataFrame) -> DataFrame:
    """Add common names once; an index that has them is returned unchanged."""
    if "nombre_comun_es_ar" in index.columns:
        return index
    return index.join(names, "species", "left")


def dataset_statistics(rows: DataFrame, group: str, value: str) -> DataFrame:
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )


def hierarchy_counts(rows: DataFrame, levels: list[str]) -> DataFrame:
    """Counts at every level of a hierarchy, with subtotals (null below the level)."""
    return rows.rollup(*levels).agg(F.count(F.lit(1)).alias("n"))


def curation_totals(rows: DataFrame, family: str, active: Column) -> DataFrame:
    return rows.groupBy(family).agg(
        F.count_if(active).alias("activo"),
        F.count_if(~active).alias("borrado"),
        F.count(F.lit(1)).alias("total_original"),
    )


def split_counts(index: DataFrame) -> DataFrame:
    """Sizes of the splits; an index without dev rows falls back to the old query split."""
    of = lambda s: F.count_if(F.col("split") == s)
    dev = F.nullif(of("query_dev"), F.lit(0))
    return index.agg(
        F.coalesce(dev, of("query")).alias("query_count"),
        of("query_test").alias("query_test_count"),
        of("gallery").alias("gallery_count"),
        F.count(F.lit(1)).alias("total_images"),
        F.count_distinct("species").alias("total_species"),
    )


def species_per_category(index: DataFrame) -> DataFrame:
    return index.groupBy("category").agg(F.count_distinct("species").alias("n_species"))


def unscored_species(index: DataFrame) -> DataFrame:
    return index.where(F.col("score") == 0).select("species").distinct().orderBy("species")
