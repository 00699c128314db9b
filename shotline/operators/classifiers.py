"""Classifier grid: each classifier is a function (gallery, queries) -> predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotline.functions import blocks
from shotline.functions.vectors import dot
from shotline.operators import cascade, centroid, search
from shotline.session import lookup, materialize, shared_root

Classifier = Callable[[DataFrame, DataFrame], DataFrame]


TOP = 5  # labels listed in ``top``
VOTED = 256  # rows whose leaves are added up together


def nearest_mean(gallery: DataFrame, queries: DataFrame) -> DataFrame:
    means = centroid.centroids(gallery, renormalise=False, gallery_only=False)
    near = search.nearest(centroid.normalised(queries), means, TOP, metric="euclidean")
    listed = F.array_sort(F.collect_list(F.struct("rank", "neighbour")))
    by_item = near.groupBy("item_id", F.col("species").alias("y_true")).agg(listed.alias("_l"))
    top = F.transform("_l", lambda x: x["neighbour"])
    return by_item.select("item_id", "y_true", top[0].alias("y_pred"), top.alias("top"))


@dataclass(frozen=True)
class Knn:
    """Majority vote of ``k``; ``top`` orders the labels among the neighbours by their share of votes."""

    k: int

    def __call__(self, gallery: DataFrame, queries: DataFrame) -> DataFrame:
        return self.vote(search.nearest(queries, gallery, self.k))

    def vote(self, near: DataFrame) -> DataFrame:
        """The answers from neighbours found before, ``k`` or more of each item."""
        near = near.where(F.col("rank") <= self.k)
        votes = cascade.majority_vote(near, [self.k]).select("item_id", F.col("species").alias("y_true"), "y_pred")
        shares = near.groupBy("item_id", "neighbour").agg(F.count(F.lit(1)).alias("n"))
        order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "neighbour")))
        ranked = shares.groupBy("item_id").agg(F.slice(F.transform(order, lambda x: x["neighbour"]), 1, TOP).alias("_t"))
        first = F.concat(F.array("y_pred"), F.array_remove("_t", F.col("y_pred")))
        return votes.join(ranked, "item_id").select("item_id", "y_true", "y_pred", first.alias("top"))


def knn(k: int) -> Classifier:
    return Knn(k)


def sharing(known: dict[str, Classifier]) -> dict[str, Classifier]:
    """The classifiers for one set of rows: the neighbours, of the largest k, are searched and stored once for all k."""
    ks = [c.k for c in known.values() if isinstance(c, Knn)]
    kept: list[DataFrame] = []

    def voting(one: Knn) -> Classifier:
        def run(gallery: DataFrame, queries: DataFrame) -> DataFrame:
            if not kept:
                kept.append(materialize(search.nearest(queries, gallery, max(ks))))
            return one.vote(kept[0])

        return run

    return {name: voting(c) if isinstance(c, Knn) else c for name, c in known.items()}


ROWS_PER_PARTITION = 20_000


def _as_features(rows: DataFrame) -> DataFrame:
    return centroid.normalised(rows).withColumn("features", array_to_vector("vec"))


def trained(make: Callable[[int], Estimator], gallery: DataFrame) -> tuple[Model, list[str]]:
    """Spark ML model of the gallery and its labels by index; ``make`` receives the number of training rows."""
    indexer = StringIndexer(inputCol="species", outputCol="label", stringOrderType="alphabetAsc").fit(gallery)
    train = indexer.transform(_as_features(gallery)).select("label", "features").persist()
    n = train.count()
    # solvers run one job per iteration: no more partitions than the rows deserve
    compact = train.coalesce(n // ROWS_PER_PARTITION + 1).persist()
    model = make(n).fit(compact)
    compact.unpersist()
    train.unpersist()
    return model, indexer.labels


def _fitted(make: Callable[[int], Estimator]) -> Classifier:
    """Spark ML estimator over the gallery."""

    def run(gallery: DataFrame, queries: DataFrame) -> DataFrame:
        model, labels = trained(make, gallery)
        scored = model.transform(_as_features(queries))
        named = IndexToString(inputCol="prediction", outputCol="y_pred", labels=labels)
        # decision values or probabilities, the larger the likelier
        values = vector_to_array("probability" if "probability" in scored.columns else "rawPrediction")
        order = F.array_sort(F.transform(values, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
        names = F.array(*[F.lit(name) for name in labels])
        top = F.transform(F.slice(order, 1, TOP), lambda x: F.get(names, x["i"]))
        return named.transform(scored).select("item_id", F.col("species").alias("y_true"), "y_pred", top.alias("top"))

    return run


def linear_svm(n: int) -> Estimator:
    # the solver averages the loss, so a cost of 1 is a penalty of 1 / n
    solver = LinearSVC(maxIter=2_000, tol=1e-4, regParam=1.0 / max(n, 1), standardization=False)
    return OneVsRest(classifier=solver, parallelism=8)


def forest(n: int) -> Estimator:
    return RandomForestClassifier(numTrees=100, seed=29)


REGISTRY: dict[str, Classifier] = {
    "Nearest Centroid": nearest_mean,
    "KNN (k=1)": knn(1),
    "KNN (k=3)": knn(3),
    "KNN (k=5)": knn(5),
    "Linear SVM": _fitted(linear_svm),
    "Random Forest": _fitted(forest),
}


def evaluate(
    rows: DataFrame,
    model: str,
    names: list[str],
    done: DataFrame | None = None,
    own: dict[str, Classifier] | None = None,
    top: bool = False,
) -> DataFrame:
    """Long predictions (model, classifier, item_id, y_true, y_pred) of the named classifiers.

    ``top`` adds the likeliest labels, best first. ``own`` adds a caller's classifiers. Pairs listed in ``done`` (model, classifier) are
    not run again.
    """
    known = {**REGISTRY, **(own or {})}
    if done is not None:
        asked = done.where((F.col("model") == model) & F.col("classifier").isin(names))
        skip = {r["classifier"] for r in asked.select("classifier").distinct().collect()}
        names = [n for n in names if n not in skip]
    gallery = rows.where(F.col("split") == "gallery")
    queries = rows.where(F.col("split") != "gallery")
    out = None
    for name in names:
        part = known[name](gallery, queries).select(
            F.lit(model).alias("model"), F.lit(name).alias("classifier"), "item_id", "y_true", "y_pred", *(["top"] if top else [])
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("every classifier has been evaluated already")
    return out


# --- what must hold for trained models, by plain sums over the rows ---------------------------


def svm_weights(model: Model, labels: list[str], spark) -> DataFrame:
    """(label, species, w, b): the separating plane of each class, as many rows as the model has."""
    planes = [
        (i, name, [float(x) for x in m.coefficients], float(m.intercept))
        for i, (name, m) in enumerate(zip(labels, model.models))
    ]
    return spark.createDataFrame(planes, "label int, species string, w array<double>, b double")


def _against_planes(rows: DataFrame, planes: DataFrame, classes: int) -> DataFrame:
    """Every row with the decision value of every class."""
    each = centroid.normalised(rows).withColumn("label", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    named = planes.withColumnRenamed("species", "class")
    return each.join(lookup(named), "label").withColumn("value", dot(F.col("vec"), F.col("w")) + F.col("b"))


def model_labels(model: Model, labels: list[str], queries: DataFrame) -> DataFrame:
    """(item_id, y_true, y_pred) as the model itself answers."""
    names = F.array(*[F.lit(name) for name in labels])
    answer = F.get(names, F.col("prediction").cast("int")).alias("y_pred")
    return model.transform(_as_features(queries)).select("item_id", F.col("species").alias("y_true"), answer)


def svm_optimality(gallery: DataFrame, planes: DataFrame, edge: float = 1e-2, slack: float = 1e-3) -> DataFrame:
    """Per class: training rows, the objective, the one of the zero plane, and whether the plane is optimal.

    The objective is the mean hinge loss plus half the squared length of w over n (cost 1). A plane
    is optimal when its subgradient can be zero: rows inside the margin pull with their
    whole vector, rows on the margin (within ``edge``) with any share of it, each component to
    within ``slack``.
    """
    n, classes = gallery.count(), planes.count()
    sign = F.when(F.col("species") == F.col("class"), 1.0).otherwise(-1.0)
    rows = _against_planes(gallery, planes, classes).withColumn("_sign", sign)
    margin = rows.withColumn("_margin", F.col("_sign") * F.col("value"))
    on = F.abs(F.col("_margin") - 1) <= edge

    def pulled(which: Column, part) -> Column:
        vec = F.transform("vec", lambda x: F.when(which, part(x * F.col("_sign"))).otherwise(0.0))
        return vector_to_array(Summarizer.sum(array_to_vector(vec)))

    sums = margin.groupBy("label", F.col("class").alias("species")).agg(
        F.count(F.lit(1)).alias("n_train"),
        F.count_if(F.col("_sign") > 0).alias("n_positive"),
        F.avg(F.greatest(F.lit(0.0), 1 - F.col("_margin"))).alias("loss"),
        F.first("w").alias("w"),
        pulled(~on & (F.col("_margin") < 1), lambda x: x).alias("inside"),
        pulled(on, lambda x: F.greatest(x, F.lit(0.0))).alias("most"),
        pulled(on, lambda x: F.least(x, F.lit(0.0))).alias("least"),
    )
    at = lambda name, i: F.get(name, i)
    low = F.transform("w", lambda x, i: (x - at("inside", i) - at("most", i)) / n)
    high = F.transform("w", lambda x, i: (x - at("inside", i) - at("least", i)) / n)
    zero = F.forall(low, lambda x: x <= slack) & F.forall(high, lambda x: x >= -slack)
    return sums.select(
        "species",
        "n_train",
        "n_positive",
        (F.col("loss") + dot(F.col("w"), F.col("w")) / (2 * n)).alias("objective"),
        F.lit(1.0).alias("objective_at_zero"),
        zero.alias("optimal"),
    )


def svm_labels(queries: DataFrame, planes: DataFrame) -> DataFrame:
    """(item_id, y_true, y_pred): the class of the largest decision value, from the weights alone."""
    rows = _against_planes(queries, planes, planes.count())
    best = F.max_by("class", F.struct("value", -F.col("label")))
    return rows.groupBy("item_id", F.col("species").alias("y_true")).agg(best.alias("y_pred"))


def forest_leaves(model: Model, spark) -> DataFrame:
    """(tree, leaf, share): the class shares of every leaf, read from the stored model; leaves count in pre-order."""
    path = f"{shared_root(spark)}/forest-{model.uid}"
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    number = F.row_number().over(Window.partitionBy("tree").orderBy("id")) - 1
    leaves = nodes.where("leftChild < 0").withColumn("leaf", number)
    total = F.aggregate("impurityStats", F.lit(0.0), lambda s, x: s + x)
    return leaves.select("tree", "leaf", F.transform("impurityStats", lambda x: x / total).alias("share"))


def forest_votes(model: Model, labels: list[str], queries: DataFrame) -> DataFrame:
    """(item_id, y_true, y_pred, trees, votes, y_votes): the forest's answer and what its trees' leaves add up to.

    The leaves of the model, as many as it has whatever the rows, go to every task; a row adds up its own there.
    """
    spark = queries.sparkSession
    table = forest_leaves(model, spark).toArrow()
    tree, leaf = (table.column(c).to_numpy() for c in ("tree", "leaf"))
    shares = np.full((tree.max() + 1, leaf.max() + 1, len(labels)), np.nan)  # nan: no such leaf
    shares[tree, leaf] = blocks.vectors(table.column("share"))
    shared = spark.sparkContext.broadcast(shares)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(len(shared.value))
        for whole in batches:
            for at in range(0, whole.num_rows, VOTED):
                batch = whole.slice(at, VOTED)
                each = shared.value[place, blocks.vectors(batch.column("leaves")).astype(int)]
                met = ~np.isnan(each).any(2)
                votes = np.nansum(each, 1)
                offsets = pa.array(np.arange(len(votes) + 1, dtype=np.int32) * votes.shape[1])
                lists = pa.ListArray.from_arrays(offsets, pa.array(votes.ravel()))
                columns = [*(batch.column(c) for c in ("item_id", "y_true", "y_pred")), pa.array(met.sum(1)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "y_true", "y_pred", "met", "share"])

    scored = model.copy().setLeafCol("leaves").transform(_as_features(queries))
    names = F.array(*[F.lit(name) for name in labels])
    rows = scored.select(
        "item_id", F.col("species").alias("y_true"), F.get(names, F.col("prediction").cast("int")).alias("y_pred"),
        vector_to_array("leaves").alias("leaves"),
    )
    kinds = T.StructType([rows.schema[c] for c in ("item_id", "y_true", "y_pred")])
    kinds = kinds.add("met", T.LongType()).add("share", T.ArrayType(T.DoubleType()))
    sums = rows.mapInArrow(add, kinds).groupBy("item_id", "y_true", "y_pred").agg(
        F.max("met").alias("trees"), vector_to_array(Summarizer.sum(array_to_vector("share"))).alias("votes")
    )
    first = F.array_position(F.transform("votes", lambda x: F.round(x, 9)), F.round(F.array_max("votes"), 9)) - 1
    return sums.withColumn("y_votes", F.get(names, first.cast("int")))
