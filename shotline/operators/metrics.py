"""Classification and cluster-quality metrics.

Everything about predictions starts from confusion cells, one row per
(true, predicted) pair, so that the predictions are read and shuffled once.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotline.functions.vectors import as_double, dot, euclidean, unit
from shotline.operators import centroid, search
from shotline.session import lookup, materialize


def confusion(predictions: DataFrame, by: list[str]) -> DataFrame:
    return predictions.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def ratio(top: Column, bottom: Column) -> Column:
    """Guarded division: 0 when the denominator is 0."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def accuracy(cells: DataFrame, by: list[str]) -> DataFrame:
    hit = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    return cells.groupBy(*by).agg((hit / F.sum("n")).alias("accuracy"), F.sum("n").alias("n_items"))


def per_label(cells: DataFrame, by: list[str]) -> DataFrame:
    """tp, true and predicted counts of every label seen on either side."""
    n = F.col("n")
    hit = F.when(F.col("y_true") == F.col("y_pred"), n).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), n.alias("n_true"), zero.alias("n_pred"), hit.alias("tp")),
        F.struct(F.col("y_pred").alias("label"), zero.alias("n_true"), n.alias("n_pred"), zero.alias("tp")),
    )
    long = cells.select(*by, F.inline(sides))
    return long.groupBy(*by, "label").agg(
        F.sum("n_true").alias("n_true"), F.sum("n_pred").alias("n_pred"), F.sum("tp").alias("tp")
    )


def macro_scores(cells: DataFrame, by: list[str], labels: str = "union") -> DataFrame:
    """Macro precision, recall and F1 with zero division 0.

    ``labels='union'`` averages over true and predicted labels, ``'true'`` over
    the labels that occur as truth.
    """
    counts = per_label(cells, by)
    if labels == "true":
        counts = counts.where(F.col("n_true") > 0)
    tp, n_true, n_pred = F.col("tp"), F.col("n_true"), F.col("n_pred")
    return counts.groupBy(*by).agg(
        F.avg(ratio(tp, n_pred)).alias("precision"),
        F.avg(ratio(tp, n_true)).alias("recall"),
        F.avg(ratio(2 * tp, n_true + n_pred)).alias("f1"),
        F.count(F.lit(1)).alias("n_labels"),
    )


def topk_accuracy(ranked: DataFrame) -> DataFrame:
    """Share of items whose class is in their ``labels`` array."""
    hit = F.array_contains("labels", F.col("y_true")).cast("double")
    return ranked.agg(F.avg(hit).alias("topk_accuracy"), F.count(F.lit(1)).alias("n_items"))


def binary_scores(rows: DataFrame, truth: str, guess: str, by: list[str] | None = None) -> DataFrame:
    """tn, fp, fn, tp with precision, recall, F1 and false-alarm rate (column values 0/1)."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    counted = rows.groupBy(*(by or [])).agg(
        F.count_if(~t & ~g).alias("tn"),
        F.count_if(~t & g).alias("fp"),
        F.count_if(t & ~g).alias("fn"),
        F.count_if(t & g).alias("tp"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counted.select(
        "*",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(fp, fp + tn).alias("false_alarm_rate"),
    )


def silhouette(rows: DataFrame) -> DataFrame:
    """Mean cosine silhouette of all rows, exact, in one pass over the class means.

    For unit vectors the mean cosine distance to a class is one minus the dot
    product with the class mean; inside the own class the row itself is taken
    out by n / (n - 1). Classes of one item score 0.
    """
    sums = materialize(centroid.class_sums(centroid.normalised(rows)))
    means = centroid.as_gallery(sums, renormalise=False)
    near = search.label_minima(rows, means, metric="cosine_to_mean")
    joined = near.join(sums.select("species", F.col("n").alias("_n")), "species")
    n = F.col("_n")
    a = F.col("d_same") * n / (n - 1)
    b = F.col("d_other")
    score = F.when(n == 1, 0.0).otherwise((b - a) / F.greatest(a, b))
    return joined.agg(F.avg(score).alias("silhouette"))


def davies_bouldin(rows: DataFrame) -> DataFrame:
    """Mean over classes of the worst (S_i + S_j) / M_ij, on normalised rows."""
    rows = centroid.normalised(rows)
    means = materialize(centroid.as_gallery(centroid.class_sums(rows), renormalise=False))
    own = lookup(means.select("species", F.col("vec").alias("_c")), search.BROADCAST_ROWS)
    spread = (
        rows.join(own, "species")
        .groupBy("species")
        .agg(F.avg(euclidean(F.col("vec"), F.col("_c"))).alias("scale"))
    )
    classes = means.join(spread, "species").select("item_id", "species", "vec", "scale")
    return search.worst_overlap(classes).agg(F.avg("overlap").alias("davies_bouldin"))


def calinski_harabasz(rows: DataFrame) -> DataFrame:
    """Between/within variance ratio from sums and squared lengths only."""
    rows = centroid.normalised(rows)
    squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    classes = (
        rows.groupBy("species")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(squares).alias("squares"),
            Summarizer.sum(array_to_vector("vec")).alias("total"),
        )
        .withColumn("t", vector_to_array("total"))
    )
    whole = classes.agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.sum("squares").alias("squares"),
        F.sum(dot(F.col("t"), F.col("t")) / F.col("n")).alias("class_part"),
        Summarizer.sum(F.col("total")).alias("g"),
    ).withColumn("g", vector_to_array("g"))
    n, k = F.col("n"), F.col("k")
    between = F.col("class_part") - dot(F.col("g"), F.col("g")) / n
    within = F.col("squares") - F.col("class_part")
    return whole.select(((between / (k - 1)) / (within / (n - k))).alias("calinski_harabasz"))


def own_mean_distance(rows: DataFrame, means: DataFrame) -> DataFrame:
    """Euclidean distance of normalised rows to the plain mean of their class."""
    own = lookup(means.select("species", F.col("vec").alias("_c")), search.BROADCAST_ROWS)
    return rows.join(own, "species").select(
        "item_id", "species", euclidean(unit(as_double(F.col("vec"))), F.col("_c")).alias("distance")
    )
