"""The stored classifier grid: what a restart runs, what a failed pair leaves behind."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from shotline.operators import classifiers, grid


def rows(spark, queries=6):
    data = [(i, f"sp{i % 2}", "gallery", [1.0, float(i % 2)]) for i in range(4)]
    data += [(10 + i, f"sp{i % 2}", "query", [1.0, float(i % 2)]) for i in range(queries)]
    return spark.createDataFrame(data, "item_id long, species string, split string, vec array<double>")


def constant(label, calls):
    def run(gallery, queries):
        calls.append(label)
        return queries.select("item_id", F.col("species").alias("y_true"), F.lit(label).alias("y_pred"), F.array(F.lit(label)).alias("top"))

    return run


def broken(gallery, queries):
    return queries.select("no_such_column")


def test_a_restart_runs_only_what_is_missing(spark, tmp_path):
    calls = []
    own = {"always sp0": constant("sp0", calls), "x/y=z (k=1)": constant("sp1", calls)}
    models, path = {"a": rows(spark), "b": rows(spark)}, f"{tmp_path}/grid"
    with pytest.raises(grid.GridError, match="b / broken"):
        grid.run_grid(models, path, [*own, "broken"], own={**own, "broken": broken})
    assert len(calls) == 4  # the failing pairs did not keep the others from running
    assert grid.run_grid(models, path, list(own), own=own) == [] and len(calls) == 4
    stored = grid.predictions(spark, path)
    assert {tuple(r) for r in stored.groupBy("model", "classifier").count().collect()} == {
        (m, c, 6) for m in "ab" for c in own
    }
    scores = {(r.model, r.classifier): (r.accuracy, r.top5, r.recall) for r in grid.summary(stored).collect()}
    assert scores == {(m, c): (0.5, 0.5, 0.5) for m in "ab" for c in own}
    assert grid.latency(spark, path).where("ms_per_item > 0").count() == 4


def test_changed_catalogue_and_force_replace_only_their_pairs(spark, tmp_path):
    calls = []
    own, path = {"c": constant("sp0", calls)}, f"{tmp_path}/grid"
    assert grid.run_grid({"a": rows(spark), "b": rows(spark)}, path, ["c"], own=own) == [("a", "c"), ("b", "c")]
    assert grid.run_grid({"a": rows(spark, 9), "b": rows(spark)}, path, ["c"], own=own) == [("a", "c")]
    assert {tuple(r) for r in grid.predictions(spark, path).groupBy("model").count().collect()} == {("a", 9), ("b", 6)}
    changed = {"c": constant("sp1", calls)}
    assert grid.run_grid({"b": rows(spark)}, path, ["c"], force=True, own=changed) == [("b", "c")]
    found = grid.predictions(spark, path).groupBy("model", "y_pred").count()
    assert {tuple(r) for r in found.collect()} == {("a", "sp0", 9), ("b", "sp1", 6)}


def test_empty_store_and_no_queries(spark, tmp_path):
    path = f"{tmp_path}/grid"
    assert grid.predictions(spark, path).count() == 0
    own = {"c": constant("sp0", [])}
    assert grid.run_grid({"a": rows(spark, 0)}, path, ["c"], own=own) == [("a", "c")]
    assert grid.predictions(spark, path).count() == 0


def cloud(spark, seed, n=60):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (3, 5))
    data = [(i, f"sp{i % 3}", "gallery", [float(x) for x in centres[i % 3] + rng.normal(0, 0.6, 5)]) for i in range(n)]
    return spark.createDataFrame(data, "item_id long, species string, split string, vec array<double>")


def test_only_the_optimal_plane_passes(spark):
    rows = cloud(spark, 3)
    model, labels = classifiers.trained(classifiers.linear_svm, rows)
    planes = classifiers.svm_weights(model, labels, spark)
    found = {r.species: r for r in classifiers.svm_optimality(rows, planes).collect()}
    assert all(r.optimal and r.objective < 1 and r.n_train == 60 and r.n_positive == 20 for r in found.values())
    for moved in (planes.withColumn("b", F.col("b") + 0.3), planes.withColumn("w", F.transform("w", lambda x: x * 1.3))):
        worse = {r.species: r for r in classifiers.svm_optimality(rows, moved).collect()}
        assert all(not worse[s].optimal and worse[s].objective > found[s].objective for s in found)
    given = {r.item_id: r.y_pred for r in classifiers.model_labels(model, labels, rows).collect()}
    assert {r.item_id: r.y_pred for r in classifiers.svm_labels(rows, planes).collect()} == given


def test_forest_answers_are_the_sum_of_its_trees(spark):
    rows = cloud(spark, 4)
    model, labels = classifiers.trained(lambda n: RandomForestClassifier(numTrees=9, maxDepth=3, seed=1), rows)
    out = classifiers.forest_votes(model, labels, rows).collect()
    given = {r.item_id: r.y_pred for r in classifiers.model_labels(model, labels, rows).collect()}
    assert len(out) == 60
    assert all(r.trees == 9 and abs(sum(r.votes) - 9) < 1e-9 and r.y_votes == r.y_pred == given[r.item_id] for r in out)


def test_neighbours_are_searched_once_a_model_for_every_k(spark, tmp_path, monkeypatch):
    data, path, names = cloud(spark, 5, 90), f"{tmp_path}/grid", ["KNN (k=1)", "KNN (k=3)", "KNN (k=5)"]
    data = data.withColumn("split", F.when(F.col("item_id") % 3 == 0, "gallery").otherwise("query"))
    alone = {tuple(map(str, r)) for r in classifiers.evaluate(data, "a", names, top=True).collect()}
    asked, search = [], classifiers.search.nearest
    monkeypatch.setattr(classifiers.search, "nearest", lambda q, g, k, **more: asked.append(k) or search(q, g, k, **more))
    grid.run_grid({"a": data}, path, names)
    assert asked == [5]
    stored = grid.predictions(spark, path).select("model", "classifier", "item_id", "y_true", "y_pred", "top")
    assert {tuple(map(str, r)) for r in stored.collect()} == alone and len(alone) == 180


def test_forest_votes_make_no_row_a_tree(spark):
    rows = cloud(spark, 6)
    model, labels = classifiers.trained(lambda n: RandomForestClassifier(numTrees=9, maxDepth=3, seed=1), rows)
    twice = rows.unionByName(rows.where("item_id < 10"))
    out = classifiers.forest_votes(model, labels, twice)
    assert "Generate" not in out._jdf.queryExecution().toString()
    # equal rows of one item are added up, as before
    assert {r.item_id: (r.trees, round(sum(r.votes))) for r in out.collect()} == {i: (9, 18 if i < 10 else 9) for i in range(60)}
