"""Error analysis along a taxonomy: severity, categories, class confusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ["Correct", "Mild", "Medium", "Severe", "Critical"]
# Category labels that count as "no conservation value" in summaries.
COLLAPSED = ["Doméstica", "Exótica", "Invasora", "Exótica/Invasora", "Introducida"]
CATEGORY_ORDER = ["Crítico", "Alto", "Medio", "Bajo", "Nulo"]
COMBINED = "Medio+Bajo"


def class_dimension(spark, mapping: dict[str, list[str]]) -> DataFrame:
    """Class -> families map turned into a family -> class table."""
    literal = F.create_map(
        *[x for k, v in mapping.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]))]
    )
    return (
        spark.range(1)
        .select(F.explode(literal).alias("tclass", "families"))
        .select("tclass", F.explode("families").alias("family"))
    )


def with_taxonomy(cells: DataFrame, species: DataFrame, classes: DataFrame | None) -> DataFrame:
    """Add genus, family and class of the true and of the predicted label."""
    dim = species.select("species", "genus", "family").dropDuplicates(["species"])
    if classes is None:
        dim = dim.withColumn("tclass", F.lit(None).cast("string"))
    else:
        dim = dim.join(classes, "family", "left")
    for side in ("true", "pred"):
        named = dim.select(
            F.col("species").alias(f"y_{side}"),
            *[F.col(c).alias(f"{c}_{side}") for c in ("genus", "family", "tclass")],
        )
        cells = cells.join(named, f"y_{side}", "left")
    return cells


def severity() -> Column:
    same = [
        F.col(f"{level}_true") == F.col(f"{level}_pred") for level in ("genus", "family", "tclass")
    ]
    return (
        F.when(F.col("y_true") == F.col("y_pred"), "Correct")
        .when(same[0], "Mild")
        .when(same[1], "Medium")
        .when(same[2], "Severe")
        .otherwise("Critical")
    )


def severity_counts(
    cells: DataFrame, species: DataFrame, classes: DataFrame | None, by: list[str]
) -> DataFrame:
    """Wide table with one count column per severity."""
    graded = with_taxonomy(cells, species, classes).withColumn("severity", severity())
    return graded.groupBy(*by).agg(
        *[
            F.sum(F.when(F.col("severity") == s, F.col("n")).otherwise(0)).alias(s)
            for s in SEVERITIES
        ],
        F.sum("n").alias("n_total"),
    )


def severity_shares(counts: DataFrame) -> DataFrame:
    total = F.col("n_total")
    shares = {s: F.when(total > 0, F.col(s) / total * 100).otherwise(0.0) for s in SEVERITIES}
    return counts.withColumns({f"{s}_pct": c for s, c in shares.items()})


def severity_by_model(counts: DataFrame) -> DataFrame:
    """Percent per classifier first, then the plain mean over classifiers."""
    shares = severity_shares(counts)
    return shares.groupBy("model").agg(*[F.avg(f"{s}_pct").alias(s) for s in SEVERITIES])


def score_category(score: Column, zero: str = "Exótica/Invasora/Desconocida") -> Column:
    return (
        F.when(score == 0, zero)
        .when(score <= 2, "Bajo")
        .when(score < 4, "Medio")
        .when(score < 5, "Alto")
        .otherwise("Crítico")
    )


def collapse_category(category: Column) -> Column:
    return F.when(F.trim(category).isin(COLLAPSED), "Nulo").otherwise(F.trim(category))


def with_combined(rows: DataFrame, category: str = "category") -> DataFrame:
    """Repeat Medio and Bajo rows under a combined pseudo-category."""
    both = F.when(F.col(category).isin("Medio", "Bajo"), F.lit(COMBINED))
    return rows.withColumn(category, F.explode(F.array_compact(F.array(F.col(category), both))))


def category_counts(cells: DataFrame, categories: DataFrame, by: list[str]) -> DataFrame:
    """Correct and incorrect counts per category of the true label."""
    dim = categories.select(F.col("species").alias("y_true"), "category").dropDuplicates(["y_true"])
    joined = cells.join(dim, "y_true", "left").withColumn(
        "category", F.coalesce("category", F.lit("Desconocido"))
    )
    hit = F.col("y_true") == F.col("y_pred")
    return joined.groupBy(*by, "category").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("Correct"),
        F.sum(F.when(~hit, F.col("n")).otherwise(0)).alias("Incorrect"),
    )


def category_pivot(counts: DataFrame, categories: list[str]) -> DataFrame:
    """Model x category table of the mean percentage correct."""
    total = F.col("Correct") + F.col("Incorrect")
    shares = counts.withColumn("pct", F.when(total > 0, F.col("Correct") / total * 100))
    return shares.groupBy("model").pivot("category", categories).agg(F.avg("pct"))


def status_shares(counts: DataFrame, by: list[str] = []) -> DataFrame:
    """Long (category, status, count, percentage inside the category), for each group of ``by``."""
    long = counts.unpivot([*by, "category"], ["Correct", "Incorrect"], "status", "count")
    total = F.sum("count").over(Window.partitionBy(*by, "category"))
    return long.withColumn("percentage", F.when(total > 0, F.col("count") / total * 100).otherwise(0.0))


def class_performance(cells: DataFrame, species: DataFrame, classes: DataFrame, by: list[str] = []) -> DataFrame:
    """Accuracy and critical-error rate per true taxonomic class (and ``by``)."""
    graded = with_taxonomy(cells, species, classes).withColumn("severity", severity())
    share = lambda s: F.sum(F.when(F.col("severity") == s, F.col("n")).otherwise(0)) / F.sum("n")
    return (
        graded.where(F.col("tclass_true").isNotNull())
        .groupBy(*by, F.col("tclass_true").alias("tclass"))
        .agg(
            F.sum("n").alias("n_samples"),
            share("Correct").alias("accuracy"),
            (share("Critical") * 100).alias("critical_rate"),
        )
    )


def class_confusion(
    cells: DataFrame, species: DataFrame, classes: DataFrame, order: list[str], by: list[str] = []
) -> DataFrame:
    """Row-normalised class confusion in percent; predicted classes outside ``order`` are dropped.

    Every group of ``by`` has a row for each class of ``order``.
    """
    graded = with_taxonomy(cells, species, classes).where(F.col("tclass_true").isin(order))
    cell = lambda c: F.sum(F.when(F.col("tclass_pred") == c, F.col("n")).otherwise(0)) / F.sum("n") * 100
    found = graded.groupBy(*by, F.col("tclass_true").alias("tclass")).agg(*[cell(c).alias(c) for c in order])
    groups = cells.select(*by).distinct() if by else found.sparkSession.range(1)
    axis = groups.select(*by, F.explode(F.array(*[F.lit(c) for c in order])).alias("tclass"))
    return axis.join(found, [*by, "tclass"], "left").fillna(0.0, order)
