"""Summaries per model and classifier: best rows, orders, time joins, exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotline.operators import metrics
from shotline.operators.percentiles import exact_percentiles
from shotline.operators.scan import across

# Column spellings are fixed by the stored result files; the right side is the one name used afterwards.
CANONICAL = {
    "F1-Macro": "F1_Macro",
    "F1 Score Macro": "F1_Macro",
    "F1 Score (Macro)": "F1_Macro",
    "F1 Score": "F1_Macro",
    "Latency per image (ms)": "Backbone Time (ms)",
    "Latency (ms)": "Backbone Time (ms)",
    "Inference Time Classifier (ms/img)": "Classifier Time (ms)",
    "Num Classes": "N_Classes",
    "Embedding Dim": "Dim",
    "Embedding Dimension": "Dim",
    "Davies-Bouldin Score": "Davies-Bouldin Index",
    "Calinski-Harabasz Score": "Calinski-Harabasz Index",
    "family": "Family",
}


def summarise(cells: DataFrame) -> DataFrame:
    by = ["model", "classifier"]
    acc = metrics.accuracy(cells, by).select(*by, F.round("accuracy", 6).alias("accuracy"))
    f1 = metrics.macro_scores(cells, by).select(*by, F.round("f1", 6).alias("f1"))
    return acc.join(f1, by)


def _best_first(group: list[str], metric: str, tie: str):
    return Window.partitionBy(*group).orderBy(F.desc(metric), tie)


def best_per_group(rows: DataFrame, group: list[str], metric: str, tie: str) -> DataFrame:
    rank = F.row_number().over(_best_first(group, metric, tie))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def flag_best(rows: DataFrame, group: list[str], metric: str, tie: str) -> DataFrame:
    return rows.withColumn("is_best", F.row_number().over(_best_first(group, metric, tie)) == 1)


def rows_by_mean(rows: DataFrame, metric: str) -> DataFrame:
    means = rows.groupBy("model").agg(F.round(F.avg(metric), 6).alias("row_mean"))
    return across(means, [F.desc("row_mean"), F.col("model")], {"position": F.lit(1)})


def target_models(summary: DataFrame, times: DataFrame, n: int) -> DataFrame:
    """Models among the n best by F1 or the n fastest."""
    best = summary.groupBy("model").agg(F.max("f1").alias("f1")).orderBy(F.desc("f1"), "model").limit(n)
    fast = times.orderBy("time_ms", "model").limit(n)
    return best.select("model").union(fast.select("model")).distinct()


def pareto(summary: DataFrame, times: DataFrame) -> DataFrame:
    """Best row per model with its time; flagged when no model is both better and faster."""
    best = best_per_group(summary, ["model"], "f1", "classifier").join(times, "model")
    per_time = best.groupBy("time_ms").agg(F.max("f1").alias("_level"))
    best = best.join(across(per_time, [F.col("time_ms")], maxes_before={"_faster": F.col("_level")}), "time_ms")
    return (
        best.withColumn(
            "non_dominated",
            (F.col("_faster").isNull() | (F.col("_faster") < F.col("f1")))
            & (F.col("_level") == F.col("f1")),
        )
        .drop("_faster", "_level")
    )


def with_total_time(summary: DataFrame, times: DataFrame) -> DataFrame:
    joined = summary.join(times.select("model", "time_ms"), "model", "left")
    return joined.withColumn("total_ms", F.col("time_ms") + F.col("clf_ms"))


def pending_pairs(wanted: DataFrame, done: DataFrame) -> DataFrame:
    return wanted.join(done.select("model", "classifier"), ["model", "classifier"], "left_anti")


def lacks(column: str, part: str) -> Column:
    """Whether a name does not contain ``part``, whatever its case; true for null."""
    return ~F.coalesce(F.lower(column).contains(part), F.lit(False))


def canonical_columns(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed(CANONICAL)


def rounded(rows: DataFrame, times: list[str]) -> DataFrame:
    """Times to one decimal, other floating columns to four."""
    numeric = [f.name for f in rows.schema if f.dataType.simpleString() in ("double", "float")]
    return rows.withColumns({c: F.round(c, 1 if c in times else 4) for c in numeric})


def architecture(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "architecture": F.replace(F.replace("model", F.lit("_gap"), F.lit("")), F.lit("_cls"), F.lit("")),
            "pooling": F.when(F.col("model").contains("gap"), "GAP").otherwise("CLS"),
        }
    )


def custom_order(rows: DataFrame, column: str, first: list[str]) -> DataFrame:
    """Listed values first, in list order; the rest after them by name."""
    place = F.array_position(F.array(*[F.lit(v) for v in first]), F.col(column))
    order = [F.when(place > 0, place).otherwise(len(first) + 1), F.col(column)]
    return across(rows, order, {"position": F.lit(1)})


def mean_latency(timings: DataFrame) -> DataFrame:
    return timings.groupBy("classifier").agg(F.avg("ms").alias("mean_ms")).orderBy("mean_ms")


def latency_summary(timings: DataFrame) -> DataFrame:
    means = timings.groupBy("classifier").agg(F.avg("ms").alias("mean_ms"))
    marks = exact_percentiles(timings, ["classifier"], "ms", {"median_ms": 0.5, "p95_ms": 0.95})
    return means.join(marks, "classifier")


def dispersion(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Spread of a metric over classifiers and the classifier at each extreme."""
    return rows.groupBy(*by).agg(
        F.min(value).alias("disp_min"),
        F.max(value).alias("disp_max"),
        (F.max(value) - F.min(value)).alias("disp_range"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("disp_std"),
        F.min_by("classifier", F.struct(value, "classifier")).alias("disp_min_classifier"),
        F.min_by("classifier", F.struct(-F.col(value), "classifier")).alias("disp_max_classifier"),
    )


def first_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A deterministic pick instead of an arbitrary duplicate."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_r")).select(*keys, "_r.*")


def alignment(truths: DataFrame, reference: str) -> DataFrame:
    """Per model: how many items carry another truth than in the reference model."""
    ref = truths.where(F.col("model") == reference).select("item_id", F.col("y_true").alias("_ref"))
    joined = truths.join(ref, "item_id", "left")
    bad = F.count_if(~F.col("y_true").eqNullSafe(F.col("_ref")))
    return joined.groupBy("model").agg(bad.alias("mismatches")).withColumn(
        "aligned", F.col("mismatches") == 0
    )


def forest_table(ci: DataFrame) -> DataFrame:
    best = ci.agg(F.max("mean")).scalar()
    return ci.select(
        "series",
        "mean",
        (F.col("mean") - F.col("ci_lower")).alias("err_lo"),
        (F.col("ci_upper") - F.col("mean")).alias("err_hi"),
        best.alias("best_mean"),
    ).orderBy(F.desc("mean"), "series")


def at_largest(rows: DataFrame, size: str, metric: str) -> DataFrame:
    top = rows.agg(F.max(size).alias(size))
    return rows.join(top, size, "left_semi").orderBy(F.desc(metric))
