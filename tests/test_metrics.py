import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotline.functions.digests import leading_numbers
from shotline.operators import bootstrap, calibrate, draws, leaderboard, metrics, openset, splits, taxonomy

TRUE = list("aaaaabbbbccc")
PRED = list("aaabzbbbacca")  # z never occurs as truth


def cells(spark):
    rows = [("m", t, p) for t, p in zip(TRUE, PRED)]
    return metrics.confusion(spark.createDataFrame(rows, "model string, y_true string, y_pred string"), ["model"])


def f1(label):
    tp = sum(t == p == label for t, p in zip(TRUE, PRED))
    return 2 * tp / (TRUE.count(label) + PRED.count(label))


def test_scores_of_a_small_confusion(spark):
    assert metrics.accuracy(cells(spark), ["model"]).first()["accuracy"] == pytest.approx(8 / 12)
    union = metrics.macro_scores(cells(spark), ["model"]).first()
    truth = metrics.macro_scores(cells(spark), ["model"], "true").first()
    assert union["n_labels"] == 4 and truth["n_labels"] == 3
    assert truth["f1"] == pytest.approx(np.mean([f1(x) for x in "abc"]))
    assert union["f1"] == pytest.approx(truth["f1"] * 3 / 4)
    assert union["recall"] == pytest.approx((3 / 5 + 3 / 4 + 2 / 3) / 4)


def test_binary_scores_without_positives(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0)], "t int, g int")
    row = metrics.binary_scores(rows, "t", "g").first()
    assert (row["tn"], row["precision"], row["false_alarm_rate"]) == (2, 0.0, 0.0)


def clouds(seed=3):
    rng = np.random.default_rng(seed)
    labels = np.array(list("a" * 12 + "b" * 9 + "c" * 7 + "d"))
    centre = {c: rng.normal(size=5) for c in "abcd"}
    return np.vstack([centre[c] + 0.6 * rng.normal(size=5) for c in labels]), labels


def test_cluster_indices_equal_their_definitions(spark):
    x, labels = clouds()
    rows = spark.createDataFrame(
        [(i, l, [float(a) for a in v]) for i, (v, l) in enumerate(zip(x, labels))],
        "item_id bigint, species string, vec array<double>",
    )
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    names = sorted(set(labels))
    s = []
    for i, l in enumerate(labels):
        own = (labels == l) & (np.arange(len(labels)) != i)
        if not own.any():
            s.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, labels == o].mean() for o in names if o != l)
        s.append((b - a) / max(a, b))
    assert metrics.silhouette(rows).first()[0] == pytest.approx(np.mean(s))
    mean = {c: u[labels == c].mean(0) for c in names}
    spread = {c: np.linalg.norm(u[labels == c] - mean[c], axis=1).mean() for c in names}
    worst = [
        max((spread[c] + spread[o]) / np.linalg.norm(mean[c] - mean[o]) for o in names if o != c) for c in names
    ]
    assert metrics.davies_bouldin(rows).first()[0] == pytest.approx(np.mean(worst))
    between = sum((labels == c).sum() * ((mean[c] - u.mean(0)) ** 2).sum() for c in names)
    within = sum(((u[labels == c] - mean[c]) ** 2).sum() for c in names)
    want = (between / (len(names) - 1)) / (within / (len(u) - len(names)))
    assert metrics.calinski_harabasz(rows).first()[0] == pytest.approx(want)


def test_severity_levels_and_missing_class_map(spark):
    species = spark.createDataFrame(
        [("a", "g1", "f1"), ("b", "g1", "f1"), ("c", "g2", "f1"), ("d", "g3", "f2"), ("e", "g4", "f3")],
        "species string, genus string, family string",
    )
    pairs = [("a", "a"), ("a", "b"), ("a", "c"), ("a", "d"), ("a", "e"), ("a", "zz")]
    counts = spark.createDataFrame([("m", t, p, 2) for t, p in pairs], "model string, y_true string, y_pred string, n bigint")
    classes = taxonomy.class_dimension(spark, {"Mammalia": ["f1", "f2"], "Aves": ["f3"]})
    row = taxonomy.severity_counts(counts, species, classes, ["model"]).first()
    assert [row[s] for s in taxonomy.SEVERITIES] == [2, 2, 2, 2, 4]
    row = taxonomy.severity_counts(counts, species, None, ["model"]).first()
    assert [row[s] for s in taxonomy.SEVERITIES] == [2, 2, 2, 0, 6]


def test_published_consistency_values():
    """Published numbers agree with each other under our formulas."""
    assert sum([983, 65, 20, 31, 3]) == sum([980, 58, 23, 38, 3]) == 1102
    assert 983 / 1102 == pytest.approx(0.89201, abs=5e-6)


def test_split_sizes_of_small_classes(spark):
    wanted = {1: 1, 2: 1, 3: 2, 4: 1, 5: 2, 9: 2, 10: 2, 16: 3}
    rows = [(k * 100 + i, f"n{k}") for k in wanted for i in range(k)]
    split = splits.gallery_query(spark.createDataFrame(rows, "item_id bigint, species string"))
    got = {r["species"]: r["g"] for r in split.groupBy("species").agg(F.count_if(F.col("split") == "gallery").alias("g")).collect()}
    assert got == {f"n{k}": v for k, v in wanted.items()}
    after = splits.dev_test(split)
    assert splits.split_violations(split, after).count() == 0 and after.count() == len(rows)
    tests = {r["species"]: r["t"] for r in after.groupBy("species").agg(F.count_if(F.col("split") == "query_test").alias("t")).collect()}
    for k, g in wanted.items():
        n = k - g
        assert tests[f"n{k}"] == (0 if n < 2 else max(1, min(n - 1, round(n * 0.3))))
    excluded = {r["species"] for r in splits.dev_test_excluded(split).collect()}
    assert excluded == {f"n{k}" for k, g in wanted.items() if k - g == 1}


def test_ambiguous_split_is_refused(spark):
    rows = spark.createDataFrame([(1, "gallery"), (2, "query_dev"), (3, "query_test")], "item_id int, split string")
    with pytest.raises(ValueError):
        splits.select_split(rows)
    assert splits.select_split(rows, "query_dev").count() == 2


def test_forced_rows_are_never_dropped(spark):
    rows = spark.createDataFrame([("a", i, i < 6) for i in range(30)] + [("b", 100 + i, i == 0) for i in range(3)], "grp string, item bigint, forced boolean")
    out = splits.forced_sample(rows, "grp", "item", "forced", 4).toPandas()
    assert sorted(out[out.grp == "a"]["item"]) == list(range(6))
    assert len(out[out.grp == "b"]) == 3
    assert len(splits.forced_sample(rows, "grp", "item", "forced", 10).where("grp = 'a'").collect()) == 10


def test_bootstrap_plans_agree_and_cover_the_point(spark, monkeypatch):
    rng = np.random.default_rng(1)
    truth = np.where(rng.random(1500) < 0.6, "hot", rng.choice(list("xyz"), 1500))
    rows = [
        (i, str(t), "s", c, str(t) if rng.random() < p else "w") for i, t in enumerate(truth) for c, p in (("c1", 0.8), ("c2", 0.6))
    ]
    preds = spark.createDataFrame(rows, "item_id bigint, y_true string, model string, classifier string, y_pred string")
    joint = bootstrap.joint_cells(preds, ["model", "classifier"]).cache()
    by_hash = bootstrap.resampled_cells(bootstrap.hash_draws(joint, 150, 29), joint).cache()
    by_class = bootstrap.tree_cells(joint, 150, 29).cache()
    monkeypatch.setattr(bootstrap, "BELOW", 1)  # the cells of a class lie in several tasks
    monkeypatch.setattr(bootstrap, "BLOCK", 40)
    cut = bootstrap.tree_cells(joint, 150, 29)
    assert sorted(map(tuple, by_class.collect())) == sorted(map(tuple, cut.collect()))
    sizes = {k: int((truth == k).sum()) for k in set(truth)}
    for drawn in (by_hash, by_class):
        for r in drawn.groupBy("iteration", "series", "y_true").agg(F.sum("n").alias("n")).collect():
            assert r["n"] == sizes[r["y_true"]]
    means = []
    for drawn in (by_hash, by_class):
        ci = bootstrap.interval(bootstrap.iteration_scores(drawn), ["series", "metric"])
        means.append({(r["series"], r["metric"]): r for r in ci.collect()})
    point = {r["classifier"]: r["accuracy"] for r in metrics.accuracy(metrics.confusion(preds, ["classifier"]), ["classifier"]).collect()}
    for c in ("c1", "c2"):
        a, b = means[0][(f"s|{c}", "accuracy")], means[1][(f"s|{c}", "accuracy")]
        assert a["mean"] == pytest.approx(b["mean"], abs=0.01) and a["mean"] == pytest.approx(point[c], abs=0.01)
        assert a["ci_lower"] < point[c] < a["ci_upper"] and b["ci_lower"] < point[c] < b["ci_upper"]
        assert a["ci_width"] == pytest.approx(b["ci_width"], rel=0.35)


def _uneven_predictions(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(700):
        truth = "hot" if rng.random() < 0.7 else str(rng.choice(list("xy")))
        rows += [(i, truth, "s", c, str(rng.choice([truth, "w", "z"]))) for c in ("c1", "c2", "c3")]
    rows += [(0, "hot", "s", "c1", "w"), (None, "x", "s", "c1", "x"), (None, "x", "s", "c2", "x")]  # a repeated answer, items without id
    rows += [(900, "x", "s", "c1", None), (900, "x", "s", "c2", "x"), (901, "y", "s", "c1", None), (902, None, "s", "c1", "x")]
    return spark.createDataFrame(rows, "item_id bigint, y_true string, model string, classifier string, y_pred string")


def test_joint_cells_are_those_of_listed_answers(spark):
    preds = _uneven_predictions(spark)
    answers, n = {}, {}
    for r in preds.collect():
        answers.setdefault((r.item_id, r.y_true), []).append((f"{r.model}|{r.classifier}", r.y_pred))
    for (_, truth), given in answers.items():
        cell = ",".join(f"{s}={p}" for s, p in sorted(given, key=lambda x: (x[0], x[1] or "")) if p is not None)
        n[truth, cell] = n.get((truth, cell), 0) + 1
    got = bootstrap.joint_cells(preds, ["model", "classifier"]).collect()
    assert {(r.y_true, r.cell): r.n for r in got} == n and len(got) == len(n)


@pytest.mark.parametrize("limits", [{}, {"SLOTS": 64, "DRAWN": 200, "HASHES": 900}, {"CLASS_CELLS": 12}, {"CLASS_ITEMS": 300}])
def test_hashed_draws_inside_tasks_equal_the_joined_ones(spark, monkeypatch, limits):
    joint = bootstrap.joint_cells(_uneven_predictions(spark), ["model", "classifier"]).cache()
    joined = bootstrap.resampled_cells(bootstrap.hash_draws(joint, 23, 29), joint).collect()
    for name, value in limits.items():
        monkeypatch.setattr(bootstrap, name, value)
    assert sorted(map(tuple, bootstrap.hash_cells(joint, 23, 29).collect())) == sorted(map(tuple, joined))


def test_numbered_texts_are_hashed_like_md5():
    for head, middle in (("29~", "~sp1~"), ("", "~" + "é" * 40 + "~"), ("x" * 54, ""), ("", "x" * 130)):
        want = [[int(hashlib.md5(f"{head}{r}{middle}{i}".encode()).hexdigest()[:8], 16) for i in range(98, 1003)] for r in range(8, 12)]
        assert leading_numbers(head, range(8, 12), middle, 98, 1003).tolist() == want


def test_draws_of_a_tree_are_not_put_into_one_task(spark):
    drawn = bootstrap.tree_cells(bootstrap.joint_cells(_uneven_predictions(spark), ["model", "classifier"]), 1000, 29)
    # a partitioning by columns alone may be merged by size; a stated number stays
    assert "REPARTITION_BY_NUM" in drawn._jdf.queryExecution().toString()


def test_bootstrap_of_no_predictions(spark):
    preds = spark.createDataFrame([], "item_id bigint, y_true string, model string, classifier string, y_pred string")
    assert bootstrap.tree_cells(bootstrap.joint_cells(preds, ["model", "classifier"]), 10, 29).isEmpty()


@pytest.mark.parametrize(("m", "a", "b"), [(1, 1, 9), (7, 2, 3), (40, 1, 1000), (300, 999, 1), (4000, 5, 7)])
def test_binomials_are_inverted_exactly(m, a, b):
    p = Fraction(a, a + b)
    exact = [math.comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(m + 1)] if m <= 300 else None
    u = (np.arange(20_000) + 0.5) / 20_000
    got = draws.binomials(np.full(len(u), m), np.full(len(u), a), np.full(len(u), b), u)
    assert got.min() >= 0 and got.max() <= m
    assert got.mean() == pytest.approx(float(m * p), rel=1e-3, abs=1e-3)
    assert got.var() == pytest.approx(float(m * p * (1 - p)), rel=0.02, abs=1e-3)
    if exact:  # the evenly spaced numbers fall into each value's share, to within one of them
        counts = np.bincount(got, minlength=m + 1)
        assert max(abs(c - float(e) * len(u)) for c, e in zip(counts, exact)) <= 1.01


def test_binomials_do_not_depend_on_their_neighbours():
    rng = np.random.default_rng(5)
    m, a, b = rng.integers(0, 500, 300), rng.integers(1, 50, 300), rng.integers(1, 50, 300)
    u = rng.random(300)
    alone = [int(draws.binomials(*(np.array([v[i]]) for v in (m, a, b, u)))[0]) for i in range(300)]
    assert draws.binomials(m, a, b, u).tolist() == alone


def test_uniforms_are_even_and_unrelated():
    u = draws.uniforms(draws.node_seeds(29, "k", 3, list(range(300))), np.arange(1000))
    assert abs(u.mean() - 0.5) < 0.003 and u.var() == pytest.approx(1 / 12, rel=0.01)
    assert np.histogram(u, 64, (0, 1))[0].std() < 2 * (u.size / 64) ** 0.5
    assert abs(np.corrcoef(u[:, 1:].ravel(), u[:, :-1].ravel())[0, 1]) < 0.01


def test_tree_draws_any_part_alike():
    rounds, weights = np.arange(40), np.random.default_rng(2).integers(0, 30, 64)
    whole = draws.subtree(weights, np.full(40, weights.sum()), rounds, 7, "k", 0, 6)
    assert (whole.sum(axis=1) == weights.sum()).all() and not whole[:, weights == 0].any()
    for part in range(8):  # 8 cells each, reached by the splits above them
        path = []
        for level in (1, 2, 3):
            at, span = part >> level << level, 8 << (level - 1)
            halves = weights[at * 8 : at * 8 + span].sum(), weights[at * 8 + span : at * 8 + 2 * span].sum()
            path.append((level, *map(int, halves)))
        m = draws.descend(path, part, 3, rounds, 7, "k")
        mine = draws.subtree(weights[part * 8 : part * 8 + 8], m, rounds, 7, "k", part * 8, 3)
        assert (mine == whole[:, part * 8 : part * 8 + 8]).all()


def test_histogram_puts_the_upper_edge_into_the_last_bin(spark):
    rows = spark.createDataFrame([(0.0,), (0.5,), (0.999,), (1.0,)], "v double")
    got = {r["bin"]: r["n"] for r in calibrate.histogram(rows, F.col("v"), 0.0, 1.0, 2, []).collect()}
    assert got == {0: 1, 1: 3}


def test_ranges_follow_the_data(spark):
    rows = spark.createDataFrame([(3.0,), (250.0,), (9.0,)], "v double")
    assert calibrate.value_range(rows, "v") == (3.0, 250.0)
    assert calibrate.value_range(rows.where("v > 100"), "v") == (250.0, 251.0)
    assert calibrate.value_range(rows.where("v > 1000"), "v") == (0.0, 1.0)


def test_order_of_more_than_a_hundred_listed_values(spark):
    names = [f"n{i:03d}" for i in range(120)]
    rows = spark.createDataFrame([(n,) for n in [*names, "a-unlisted"]], "c string")
    got = {r["c"]: r["position"] for r in leaderboard.custom_order(rows, "c", names).collect()}
    assert got["a-unlisted"] == 121 and [got[n] for n in names] == list(range(1, 121))


def test_scalability_takes_all_classes_last(spark):
    gallery = spark.createDataFrame([(f"c{i}",) for i in range(7)], "species string")
    got = openset.class_choices(gallery, [3, 5, 7, 50], 5, 29).groupBy("subset", "num_classes").count().collect()
    sizes = sorted((r["num_classes"], r["count"]) for r in got)
    assert sizes == [(3, 3)] * 5 + [(5, 5)] * 5 + [(7, 7)]


def test_open_set_flags_far_queries(spark):
    rng = np.random.default_rng(7)
    axis = {f"c{i}": np.eye(6)[i] for i in range(5)}
    make = lambda n, first: [
        (first + i * n + j, c, [float(x) for x in v + 0.05 * rng.normal(size=6)]) for i, (c, v) in enumerate(axis.items()) for j in range(n)
    ]
    schema = "item_id bigint, species string, vec array<double>"
    gallery, queries = spark.createDataFrame(make(20, 0), schema), spark.createDataFrame(make(10, 1000), schema)
    row = openset.open_set(gallery, queries).first()
    assert row["tp"] == 10 and row["fn"] == 0 and row["fp"] <= 8 and row["recall"] == 1.0
