"""Evaluation: metrics, error severity, calibration, bootstrap, open set, leaderboards."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from shotline.operators import (
    bootstrap,
    calibrate,
    cascade,
    centroid,
    draws,
    grid,
    leaderboard,
    metrics,
    openset,
    search,
    splits,
    taxonomy,
)
from shotline.plans import base
from shotline.plans.base import cte, query, twin
from shotline.plans.vector_queries import _VOTE
from shotline.session import delete_at_exit, lookup, materialize, shared_root

SEEN, LABELS = 24, 27  # true labels, and labels a prediction can take
FAMILIES = {"Mammalia": ["fam0", "fam1", "fam2"], "Aves": ["fam3", "fam4"], "Reptilia": ["fam5"]}
ORDER = ["Mammalia", "Aves", "Reptilia"]
MODELS = ["m1", "m2_gap", "m3"]
CLASSIFIERS = ["Faiss NN", "KNN (k=1)", "Linear SVM"]


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# --- predictions, species and latency tables derived from orders, customer, lineitem ---


def predictions(spark, d):
    """Nine (model, classifier) predictions for every order."""
    rows = base.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    grid = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                F.lit(c).alias("classifier"),
                F.lit(i * 7 + j * 13).alias("shift"),
                F.lit(55 + 5 * i + 4 * j).alias("skill"),
            )
            for i, m in enumerate(MODELS)
            for j, c in enumerate(CLASSIFIERS)
        ]
    )
    long = rows.select("*", F.inline(grid))
    noise = (F.col("o_orderkey") * 31 + F.col("o_custkey") * 17 + F.col("shift")) % 100
    true = F.concat(F.lit("sp"), F.col("o_custkey") % SEEN)
    return long.select(
        "model",
        "classifier",
        F.col("o_orderkey").alias("item_id"),
        true.alias("y_true"),
        F.when(noise < F.col("skill"), true)
        .otherwise(F.concat(F.lit("sp"), (F.col("o_custkey") + noise) % LABELS))
        .alias("y_pred"),
    )


_models = ", ".join(f"('{m}', {i * 7}, {5 * i})" for i, m in enumerate(MODELS))
_classifiers = ", ".join(f"('{c}', {j * 13}, {4 * j})" for j, c in enumerate(CLASSIFIERS))
cte(
    "preds",
    f"""SELECT model, classifier, o_orderkey AS item_id, 'sp' || (o_custkey % {SEEN}) AS y_true,
    CASE WHEN (o_orderkey * 31 + o_custkey * 17 + ms + cs) % 100 < 55 + mk + ck THEN 'sp' || (o_custkey % {SEEN})
    ELSE 'sp' || ((o_custkey + (o_orderkey * 31 + o_custkey * 17 + ms + cs) % 100) % {LABELS}) END AS y_pred
    FROM orders, (VALUES {_models}) m(model, ms, mk), (VALUES {_classifiers}) c(classifier, cs, ck)""",
)


def species_table(spark, d):
    """Species dimension with genus, family, score and category."""
    number = F.col("c_custkey") % LABELS
    rows = base.table(spark, d, "customer").select(number.alias("i")).distinct()
    manual = F.when(F.col("i") % 9 == 7, "Doméstica").when(F.col("i") % 9 == 8, "Exótica/Invasora")
    return rows.select(
        F.concat(F.lit("sp"), "i").alias("species"),
        F.concat(F.lit("gen"), F.floor(F.col("i") / 2)).alias("genus"),
        F.concat(F.lit("fam"), F.floor(F.col("i") / 4)).alias("family"),
        (F.col("i") % 6).alias("score"),
        F.coalesce(manual, taxonomy.score_category(F.col("i") % 6)).alias("category"),
    )


SCORE_SQL = """CASE WHEN {s} = 0 THEN 'Exótica/Invasora/Desconocida' WHEN {s} <= 2 THEN 'Bajo'
  WHEN {s} < 4 THEN 'Medio' WHEN {s} < 5 THEN 'Alto' ELSE 'Crítico' END"""
cte(
    "sps",
    f"""SELECT 'sp' || i AS species, 'gen' || (i // 2) AS genus, 'fam' || (i // 4) AS family, i % 6 AS score,
    CASE WHEN i % 9 = 7 THEN 'Doméstica' WHEN i % 9 = 8 THEN 'Exótica/Invasora' ELSE {SCORE_SQL.format(s='(i % 6)')} END AS category
    FROM (SELECT DISTINCT c_custkey % {LABELS} AS i FROM customer)""",
)
_fams = ", ".join(f"('{c}', '{f}')" for c, fs in FAMILIES.items() for f in fs)
cte("fams", f"SELECT * FROM (VALUES {_fams}) t(tclass, family)")


def cells(spark, d):
    return metrics.confusion(predictions(spark, d), ["model", "classifier"])


cte("cells", "SELECT model, classifier, y_true, y_pred, count(*) AS n FROM preds GROUP BY ALL", "preds")
cte(
    "labs",
    """SELECT model, classifier, label, sum(n_true) AS n_true, sum(n_pred) AS n_pred, sum(tp) AS tp FROM (
      SELECT model, classifier, y_true AS label, n AS n_true, 0 AS n_pred, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp FROM cells
      UNION ALL SELECT model, classifier, y_pred, 0, n, 0 FROM cells) GROUP BY ALL""",
    "cells",
)
cte(
    "graded",
    """SELECT c.*, ft.tclass AS tc_true, fp.tclass AS tc_pred, CASE WHEN y_true = y_pred THEN 'Correct'
      WHEN t.genus = p.genus THEN 'Mild' WHEN t.family = p.family THEN 'Medium'
      WHEN ft.tclass = fp.tclass THEN 'Severe' ELSE 'Critical' END AS severity
    FROM cells c LEFT JOIN sps t ON t.species = y_true LEFT JOIN sps p ON p.species = y_pred
    LEFT JOIN fams ft ON ft.family = t.family LEFT JOIN fams fp ON fp.family = p.family""",
    "cells",
    "sps",
    "fams",
)


def classes(spark):
    return taxonomy.class_dimension(spark, FAMILIES)


@query(
    "a1_accuracy",
    twin(
        """SELECT model, classifier, round(avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy,
        count(*) AS n_items FROM preds GROUP BY ALL""",
        "preds",
    ),
)
def a1(spark, d):
    return metrics.accuracy(cells(spark, d), ["model", "classifier"]).select(
        "model", "classifier", *r6("accuracy"), "n_items"
    )


_MACRO = """SELECT model, classifier, round(avg(CASE WHEN n_pred > 0 THEN tp::DOUBLE / n_pred ELSE 0 END), 6) AS precision,
  round(avg(CASE WHEN n_true > 0 THEN tp::DOUBLE / n_true ELSE 0 END), 6) AS recall,
  round(avg(CASE WHEN n_true + n_pred > 0 THEN 2 * tp::DOUBLE / (n_true + n_pred) ELSE 0 END), 6) AS f1,
  count(*) AS n_labels FROM labs {where} GROUP BY ALL"""


def _macro(labels):
    def run(spark, d):
        out = metrics.macro_scores(cells(spark, d), ["model", "classifier"], labels)
        return out.select("model", "classifier", *r6("precision", "recall", "f1"), "n_labels")

    return run


query("a2_macro_scores", twin(_MACRO.format(where=""), "labs"))(_macro("union"))
query("a3_macro_scores_true_labels", twin(_MACRO.format(where="WHERE n_true > 0"), "labs"))(_macro("true"))


@query(
    "a4_topk_accuracy",
    twin(
        """SELECT round(avg(hit), 6) AS topk_accuracy, count(*) AS n_items FROM (
          SELECT item_id, max(CASE WHEN csp = species THEN 1.0::DOUBLE ELSE 0 END) AS hit FROM topc WHERE rk <= 5 GROUP BY item_id)""",
        "topc",
    ),
)
def a4(spark, d):
    near = search.nearest(*base.centroid_parts(spark, d), 5)
    ranked = cascade.candidate_array(near, 5).select(
        F.col("species").alias("y_true"), F.transform("top5", lambda t: t["species"]).alias("labels")
    )
    return metrics.topk_accuracy(ranked).select(*r6("topk_accuracy"), "n_items")


@query(
    "a5_confusion",
    twin("SELECT model, classifier, y_true, y_pred, n FROM cells", "cells"),
)
def a5(spark, d):
    return cells(spark, d)


_BINARY = """SELECT tn, fp, fn, tp, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
  round(CASE WHEN fp + tn > 0 THEN fp::DOUBLE / (fp + tn) ELSE 0 END, 6) AS false_alarm_rate FROM bin"""
cte(
    "bin_labels",
    """SELECT count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp,
    count(*) FILTER (quality = 1 AND toxic <> 1) AS fn, count(*) FILTER (quality = 1 AND toxic = 1) AS tp FROM labels""",
)


@query("a46_binary_scores", twin(_BINARY.replace("FROM bin", "FROM bin_labels"), "bin_labels"))
def a46(spark, d):
    out = metrics.binary_scores(base.table(spark, d, "labels"), "quality", "toxic")
    return out.select("tn", "fp", "fn", "tp", *r6("precision", "recall", "f1", "false_alarm_rate"))


cte(
    "unitall",
    "SELECT item_id, species, vn FROM unit2",
    "unit2",
)


@query(
    "a6_silhouette",
    twin(
        """SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM (
          SELECT item_id, any_value(n) AS n, max(CASE WHEN own THEN s / (n - 1) END) AS a, min(CASE WHEN NOT own THEN s / nc END) AS b FROM (
            SELECT x.item_id, y.species = x.species AS own, sum(1 - list_inner_product(x.vn, y.vn)) AS s, count(*) AS nc,
              any_value(k.n) AS n FROM unitall x, unitall y, (SELECT species, count(*) AS n FROM unitall GROUP BY 1) k
            WHERE k.species = x.species GROUP BY x.item_id, y.species, x.species) GROUP BY item_id)""",
        "unitall",
    ),
)
def a6(spark, d):
    return metrics.silhouette(base.index(spark, d)).select(*r6("silhouette"))


cte(
    "means",
    """SELECT species, list(m ORDER BY pos) AS c, any_value(n) AS n FROM (SELECT species, pos, avg(x) AS m, count(*) AS n FROM (
      SELECT species, unnest(vn) AS x, generate_subscripts(vn, 1) AS pos FROM unitall) GROUP BY species, pos) GROUP BY species""",
    "unitall",
)


@query(
    "a7_davies_bouldin",
    twin(
        """SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT a.species, max((a.s + b.s) / list_distance(a.c, b.c)) AS r
        FROM sc a JOIN sc b ON a.species <> b.species GROUP BY a.species)""",
        "unitall",
        "means",
    ).replace(
        "\nSELECT round",
        """,
sc AS (SELECT m.species, any_value(m.c) AS c, avg(list_distance(u.vn, m.c)) AS s FROM unitall u JOIN means m USING (species) GROUP BY m.species)
SELECT round""",
    ),
)
def a7(spark, d):
    return metrics.davies_bouldin(base.index(spark, d)).select(*r6("davies_bouldin"))


@query(
    "a8_calinski_harabasz",
    twin(
        """SELECT round((between_ss / (k - 1)) / (within_ss / (n - k)), 5) AS calinski_harabasz FROM
        (SELECT count(*) AS k, sum(m.n) AS n, sum(m.n * power(list_distance(m.c, g.c), 2)) AS between_ss FROM means m,
          (SELECT list(m ORDER BY pos) AS c FROM (SELECT pos, avg(x) AS m FROM (SELECT unnest(vn) AS x, generate_subscripts(vn, 1) AS pos
            FROM unitall) GROUP BY pos)) g),
        (SELECT sum(power(list_distance(u.vn, m.c), 2)) AS within_ss FROM unitall u JOIN means m USING (species))""",
        "means",
    ),
)
def a8(spark, d):
    out = metrics.calinski_harabasz(base.index(spark, d))
    return out.select(F.round("calinski_harabasz", 5).alias("calinski_harabasz"))


_SEV = ", ".join(
    f"sum(CASE WHEN severity = '{s}' THEN n ELSE 0 END)::BIGINT AS {s}" for s in taxonomy.SEVERITIES
)
cte("sev", f"SELECT model, classifier, {_SEV}, sum(n)::BIGINT AS n_total FROM graded GROUP BY ALL", "graded")


def severities(spark, d):
    return taxonomy.severity_counts(
        cells(spark, d), species_table(spark, d), classes(spark), ["model", "classifier"]
    )


@query("a9_error_severity", twin("SELECT * FROM sev", "sev"))
def a9(spark, d):
    return severities(spark, d)


@query(
    "a10_severity_shares",
    twin(
        "SELECT *, "
        + ", ".join(f"round({s} / n_total::DOUBLE * 100, 6) AS {s}_pct" for s in taxonomy.SEVERITIES)
        + " FROM sev",
        "sev",
    ),
)
def a10(spark, d):
    shares = taxonomy.severity_shares(severities(spark, d))
    return shares.withColumns({f"{s}_pct": F.round(f"{s}_pct", 6) for s in taxonomy.SEVERITIES})


@query(
    "a11_severity_by_model",
    twin(
        "SELECT model, "
        + ", ".join(f"round(avg({s} / n_total::DOUBLE * 100), 6) AS {s}" for s in taxonomy.SEVERITIES)
        + " FROM sev GROUP BY model",
        "sev",
    ),
)
def a11(spark, d):
    out = taxonomy.severity_by_model(severities(spark, d))
    return out.select("model", *r6(*taxonomy.SEVERITIES)).orderBy(F.desc("Correct"))


cte(
    "catc",
    """SELECT model, classifier, CASE WHEN trim(category) IN ('Doméstica', 'Exótica', 'Invasora', 'Exótica/Invasora', 'Introducida')
      THEN 'Nulo' ELSE coalesce(category, 'Desconocido') END AS category,
    sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END)::BIGINT AS Correct,
    sum(CASE WHEN y_true <> y_pred THEN n ELSE 0 END)::BIGINT AS Incorrect
    FROM cells LEFT JOIN sps ON species = y_true GROUP BY ALL""",
    "cells",
    "sps",
)


def collapsed_species(spark, d):
    return species_table(spark, d).withColumn("category", taxonomy.collapse_category(F.col("category")))


def category_counts(spark, d):
    return taxonomy.category_counts(
        cells(spark, d), collapsed_species(spark, d), ["model", "classifier"]
    )


@query("a12_category_counts", twin("SELECT * FROM catc", "catc"))
def a12(spark, d):
    return category_counts(spark, d)


_CATS = ["Crítico", "Alto", "Medio", "Bajo", "Nulo"]


@query(
    "a13_category_pivot",
    twin(
        "SELECT model, "
        + ", ".join(
            f'round(avg(CASE WHEN category = \'{c}\' THEN Correct / (Correct + Incorrect)::DOUBLE * 100 END), 6) AS "{c}"'
            for c in _CATS
        )
        + " FROM catc GROUP BY model",
        "catc",
    ),
)
def a13(spark, d):
    return taxonomy.category_pivot(category_counts(spark, d), _CATS).select("model", *r6(*_CATS))


@query(
    "a14_class_performance",
    twin(
        """SELECT model, classifier, tc_true AS tclass, sum(n)::BIGINT AS n_samples, round(sum(CASE WHEN severity = 'Correct' THEN n ELSE 0 END) / sum(n)::DOUBLE, 6) AS accuracy,
        round(sum(CASE WHEN severity = 'Critical' THEN n ELSE 0 END) / sum(n)::DOUBLE * 100, 6) AS critical_rate
        FROM graded WHERE tc_true IS NOT NULL GROUP BY model, classifier, tc_true""",
        "graded",
    ),
)
def a14(spark, d):
    out = taxonomy.class_performance(cells(spark, d), species_table(spark, d), classes(spark), ["model", "classifier"])
    return out.select("model", "classifier", "tclass", "n_samples", *r6("accuracy", "critical_rate"))


@query(
    "a15_class_confusion",
    twin(
        "SELECT model, classifier, tc_true AS tclass, "
        + ", ".join(
            f"round(sum(CASE WHEN tc_pred = '{c}' THEN n ELSE 0 END) / sum(n)::DOUBLE * 100, 6) AS {c}"
            for c in ORDER
        )
        + " FROM graded WHERE tc_true IS NOT NULL GROUP BY model, classifier, tc_true",
        "graded",
    ),
)
def a15(spark, d):
    pairs = ["model", "classifier"]
    out = taxonomy.class_confusion(cells(spark, d), species_table(spark, d), classes(spark), ORDER, pairs)
    return out.select(*pairs, "tclass", *r6(*ORDER))


# --- calibration on the embedding distances -----------------------------------------

EXCLUDED = "sp9"  # stands for a class with too little support


def excluded_classes(spark, d):
    support = calibrate.class_support(base.split2(spark, d))
    return support.where(F.col("excluded") | (F.col("species") == EXCLUDED)).select("species")


def distances(spark, d):
    """Per held-out item: nearest same-class, nearest other-class and own-centroid distance."""
    rows = base.split2(spark, d)
    query_rows, gallery_rows = rows.where("split = 'query'"), rows.where("split = 'gallery'")
    cents = centroid.centroids(rows)
    near = search.label_minima(query_rows, gallery_rows)
    own = cascade.own_centroid_distance(query_rows, cents).select(
        "item_id", F.round("d_centroid", 10).alias("d_centroid")
    )
    return materialize(near.join(own, "item_id"))


cte(
    "dist",
    """SELECT n.*, o.d_centroid FROM (SELECT item_id, species, min(CASE WHEN gsp = species THEN d END) AS d_same,
      min(CASE WHEN gsp <> species THEN d END) AS d_other FROM qg GROUP BY item_id, species) n
    JOIN (SELECT item_id, d AS d_centroid FROM qc WHERE csp = species) o USING (item_id)""",
    "qg",
    "qc",
)
cte(
    "excl",
    f"""SELECT species FROM (SELECT species, count(*) FILTER (split = 'gallery') AS g FROM split2 GROUP BY species)
    WHERE g < 3 OR species = '{EXCLUDED}'""",
    "split2",
)
cte("incl", "SELECT * FROM dist WHERE species NOT IN (SELECT species FROM excl) AND d_same IS NOT NULL", "dist", "excl")

_PCT = ", ".join(f"round(quantile_cont({{c}}, {p}), 6) AS {n}" for n, p in calibrate.PERCENTILES.items())


@query("p11_included_rows", twin("SELECT item_id, species, round(d_same, 6) AS d_same FROM incl", "incl"))
def p11(spark, d):
    rows = calibrate.included(distances(spark, d), excluded_classes(spark, d), "d_same")
    return rows.select("item_id", "species", *r6("d_same"))


@query("a16_global_percentiles", twin(f"SELECT count(*) AS n, {_PCT.format(c='d_same')} FROM incl", "incl"))
def a16(spark, d):
    rows = calibrate.included(distances(spark, d), excluded_classes(spark, d), "d_same")
    return calibrate.global_percentiles(rows, "d_same").select("n", *r6(*calibrate.PERCENTILES))


_PCT_BY = f"SELECT {{k}} AS grp, count(*) AS n, {_PCT} FROM {{t}} GROUP BY 1"


@query(
    "a16_percentiles_lineitem",
    f"SELECT l_returnflag AS grp, count(*) AS n, {_PCT.format(c='l_extendedprice')} FROM lineitem GROUP BY 1",
)
def a16_lineitem(spark, d):
    """Exact percentiles of few, very large groups."""
    from shotline.operators.percentiles import exact_percentiles

    rows = base.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_extendedprice")
    out = exact_percentiles(rows, ["grp"], "l_extendedprice", calibrate.PERCENTILES)
    return out.select("grp", "n", *r6(*calibrate.PERCENTILES))


@query(
    "a17_class_percentiles",
    twin(f"SELECT species, count(*) AS n_query, {_PCT.format(c='d_same')} FROM incl GROUP BY species", "incl"),
)
def a17(spark, d):
    rows = calibrate.included(distances(spark, d), excluded_classes(spark, d), "d_same")
    return calibrate.class_percentiles(rows, "d_same").select("species", "n_query", *r6(*calibrate.PERCENTILES))


def _stats_sql(column, source="incl"):
    parts = [
        f"""SELECT '{n}' AS percentile, round(t, 6) AS threshold, round(avg(CASE WHEN {column} <= t THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage,
        round(avg(CASE WHEN d_other <= t THEN 1.0::DOUBLE ELSE 0 END), 6) AS inter_contamination,
        round(median(d_other) - t, 6) AS separation_gap
        FROM {source}, (SELECT quantile_cont({column}, {p}) AS t FROM {source}) GROUP BY t"""
        for n, p in calibrate.PERCENTILES.items()
    ]
    return " UNION ALL ".join(parts)


_STATS = ["coverage", "inter_contamination", "separation_gap"]


@query("a18_threshold_stats", twin(_stats_sql("d_same"), "incl"))
def a18(spark, d):
    rows = materialize(calibrate.included(distances(spark, d), excluded_classes(spark, d), "d_same"))
    wide = calibrate.global_percentiles(rows, "d_same")
    out = calibrate.threshold_stats(rows, calibrate.long_thresholds(wide, ["n"]))
    return out.select("percentile", *r6("threshold"), *_STATS)


@query(
    "a19_calibration",
    twin(
        f"SELECT 'nearest_neighbor' AS variant, * FROM ({_stats_sql('d_same')}) UNION ALL "
        f"SELECT 'centroid', * FROM ({_stats_sql('d_centroid')})",
        "incl",
    ),
)
def a19(spark, d):
    out = calibrate.calibrate(
        distances(spark, d),
        materialize(excluded_classes(spark, d)),
        {"nearest_neighbor": "d_same", "centroid": "d_centroid"},
    )
    return out.select("variant", "percentile", *r6("threshold"), *_STATS)


# thresholds frozen on query_dev, applied to query_test with distances to other centroids
cte(
    "unit3",
    """SELECT *, list_transform(vec, lambda x: x / sqrt(list_inner_product(vec, vec))) AS vn FROM split3""",
    "split3",
)
cte(
    "final",
    """SELECT q.item_id, q.species, q.split, max(CASE WHEN c.species = q.species THEN round(1 - list_inner_product(q.vn, c.c), 10) END) AS d_centroid,
    min(CASE WHEN c.species <> q.species THEN round(1 - list_inner_product(q.vn, c.c), 10) END) AS d_other
    FROM unit3 q, cent c WHERE q.split <> 'gallery' GROUP BY q.item_id, q.species, q.split""",
    "unit3",
    "cent",
)


def final_distances(spark, d):
    rows = base.split3(spark, d)
    cents = materialize(centroid.centroids(rows))
    held = rows.where("split <> 'gallery'")
    near = search.label_minima(held, cents).select("item_id", "d_same", "d_other")
    return held.select("item_id", "species", "split").join(near, "item_id").withColumnRenamed(
        "d_same", "d_centroid"
    )


cte(
    "frozen",
    """SELECT round(t, 6) AS threshold, round(avg(CASE WHEN d_centroid <= t THEN 1.0::DOUBLE ELSE 0 END) FILTER (ok), 6) AS coverage,
        round(avg(CASE WHEN d_other <= t THEN 1.0::DOUBLE ELSE 0 END) FILTER (ok), 6) AS inter_contamination,
        round(median(d_other) FILTER (ok) - t, 6) AS separation_gap, count(*) FILTER (ok) AS n_included, count(*) FILTER (NOT ok) AS n_excluded
        FROM (SELECT *, species NOT IN (SELECT species FROM excl) AND d_centroid IS NOT NULL AS ok FROM final WHERE split = 'query_test'),
          (SELECT quantile_cont(d_centroid, 0.95) AS t FROM final WHERE split = 'query_dev' AND species NOT IN (SELECT species FROM excl))
        GROUP BY t""",
    "final",
    "excl",
)


@query("a20_frozen_threshold", twin("SELECT * FROM frozen", "frozen"))
def a20(spark, d):
    return frozen_threshold(spark, d).select(*r6("threshold"), *_STATS, "n_included", "n_excluded")


@query(
    "a21_class_support",
    twin(
        """SELECT species, count(*) FILTER (split = 'gallery') AS gallery_count, count(*) FILTER (split = 'query') AS query_count,
        count(*) FILTER (split = 'gallery') < 3 AS excluded FROM split2 GROUP BY species""",
        "split2",
    ),
)
def a21(spark, d):
    return calibrate.class_support(base.split2(spark, d)).orderBy("gallery_count", "species")


@query(
    "a22_class_coverage",
    twin(
        """SELECT species, round(avg(CASE WHEN d_same <= t THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage, round(median(d_same), 6) AS median
        FROM incl, (SELECT quantile_cont(d_same, 0.95) AS t FROM incl) GROUP BY species""",
        "incl",
    ),
)
def a22(spark, d):
    rows = materialize(calibrate.included(distances(spark, d), excluded_classes(spark, d), "d_same"))
    threshold = calibrate.global_percentiles(rows, "d_same").first()["p95"]
    out = calibrate.class_coverage(rows, "d_same", threshold)
    return out.select("species", *r6("coverage", "median")).orderBy(F.desc("coverage"), "species")


@query("a23_correlation", twin("SELECT round(corr(d_same, d_centroid), 6) AS correlation FROM incl", "incl"))
def a23(spark, d):
    rows = calibrate.included(distances(spark, d), excluded_classes(spark, d), "d_same")
    return rows.agg(F.round(F.corr("d_same", "d_centroid"), 6).alias("correlation"))


cte(
    "sided",
    """SELECT 'intra' AS side, round(d_same, 6) AS value FROM dist WHERE d_same IS NOT NULL
    UNION ALL SELECT 'inter', round(d_other, 6) FROM dist WHERE d_other IS NOT NULL""",
    "dist",
)


@query(
    "a24_histogram",
    twin(
        """SELECT side, bin, n, round(n / (sum(n) OVER (PARTITION BY side) * width), 6) AS density FROM (
          SELECT side, least(floor((value - low) / width), 59)::INT AS bin, width, count(*) AS n FROM sided, (
            SELECT min(value) AS low, (max(value) - min(value)) / 60.0::DOUBLE AS width FROM sided) GROUP BY ALL)""",
        "sided",
    ),
)
def a24(spark, d):
    """Densities of the intra and inter distances over their common range."""
    near = distances(spark, d)
    rows = near.select(F.inline(F.array(*[
        F.struct(F.lit(side).alias("side"), F.round(column, 6).alias("value"))
        for side, column in (("intra", "d_same"), ("inter", "d_other"))
    ]))).where("value IS NOT NULL")
    low, high = calibrate.value_range(rows, "value")
    counts = calibrate.histogram(rows, F.col("value"), low, high, 60, ["side"])
    return calibrate.density(counts, low, high, 60, ["side"]).withColumn("density", F.round("density", 6))


# --- leaderboards over the (model, classifier) summary ---------------------------------


def summary(spark, d):
    return leaderboard.summarise(cells(spark, d))


cte(
    "summ",
    """SELECT model, classifier, round(a.acc, 6) AS accuracy, round(avg(CASE WHEN n_true + n_pred > 0 THEN 2 * tp::DOUBLE / (n_true + n_pred) ELSE 0 END), 6) AS f1
    FROM labs JOIN (SELECT model, classifier, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) / sum(n)::DOUBLE AS acc FROM cells GROUP BY ALL) a
    USING (model, classifier) GROUP BY model, classifier, a.acc""",
    "labs",
    "cells",
)
# forward-pass times per model, from line items
cte(
    "times",
    """SELECT ['m1', 'm2_gap', 'm3', 'm4'][l_linenumber % 4 + 1] AS model, round(avg(l_extendedprice) / 1000, 6) AS time_ms
    FROM lineitem GROUP BY 1""",
)


def model_times(spark, d):
    names = F.array(*[F.lit(m) for m in ("m1", "m2_gap", "m3", "m4")])
    rows = base.table(spark, d, "lineitem").select(
        F.element_at(names, F.col("l_linenumber") % 4 + 1).alias("model"), "l_extendedprice"
    )
    return rows.groupBy("model").agg(F.round(F.avg("l_extendedprice") / 1000, 6).alias("time_ms"))


_W1 = "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, classifier) AS rn FROM summ) WHERE rn = 1"
cte("best", _W1, "summ")


@query("w1_best_per_model", twin("SELECT * FROM best", "best"))
def w1(spark, d):
    return leaderboard.best_per_group(summary(spark, d), ["model"], "f1", "classifier")


@query(
    "w2_is_best",
    twin(
        "SELECT *, row_number() OVER (PARTITION BY model ORDER BY accuracy DESC, classifier) = 1 AS is_best FROM summ",
        "summ",
    ),
)
def w2(spark, d):
    return leaderboard.flag_best(summary(spark, d), ["model"], "accuracy", "classifier")


@query(
    "w3_rows_by_mean",
    twin(
        """SELECT model, round(avg(f1), 6) AS row_mean, row_number() OVER (ORDER BY round(avg(f1), 6) DESC, model) AS position FROM summ GROUP BY model""",
        "summ",
    ),
)
def w3(spark, d):
    return leaderboard.rows_by_mean(summary(spark, d), "f1")


@query("l1_leaderboard", twin("SELECT * FROM summ ORDER BY f1 DESC, model, classifier", "summ"))
def l1(spark, d):
    return summary(spark, d).orderBy(F.desc("f1"), "model", "classifier")


@query("l2_top_rows", twin("SELECT * FROM summ ORDER BY accuracy DESC, model, classifier LIMIT 5", "summ"))
def l2(spark, d):
    return summary(spark, d).orderBy(F.desc("accuracy"), "model", "classifier").limit(5)


@query(
    "l3_target_models",
    twin(
        """SELECT model FROM (SELECT model FROM best ORDER BY f1 DESC, model LIMIT 2)
        UNION SELECT model FROM (SELECT model FROM times ORDER BY time_ms, model LIMIT 2)""",
        "best",
        "times",
    ),
)
def l3(spark, d):
    return leaderboard.target_models(summary(spark, d), model_times(spark, d), 2)


@query(
    "l8_pareto_input",
    twin(
        """SELECT b.*, t.time_ms, NOT EXISTS (SELECT 1 FROM best o JOIN times u ON u.model = o.model WHERE o.f1 >= b.f1 AND u.time_ms <= t.time_ms
          AND (o.f1 > b.f1 OR u.time_ms < t.time_ms)) AS non_dominated FROM best b JOIN times t USING (model)""",
        "best",
        "times",
    ),
)
def l8(spark, d):
    return leaderboard.pareto(summary(spark, d), model_times(spark, d))


@query(
    "j3_best_with_latency",
    twin("SELECT b.model, b.classifier, b.accuracy, b.f1, t.time_ms FROM best b JOIN times t ON t.model = b.model", "best", "times"),
)
def j3(spark, d):
    best = leaderboard.best_per_group(summary(spark, d), ["model"], "f1", "classifier")
    return best.join(model_times(spark, d), "model")


# classifier times per (model, classifier)
cte(
    "ctimes",
    """SELECT ['Faiss NN', 'KNN (k=1)', 'Linear SVM'][l_linenumber % 3 + 1] AS classifier, round(avg(l_quantity), 6) AS clf_ms FROM lineitem GROUP BY 1""",
)


def classifier_times(spark, d):
    names = F.array(*[F.lit(c) for c in CLASSIFIERS])
    rows = base.table(spark, d, "lineitem").select(
        F.element_at(names, F.col("l_linenumber") % 3 + 1).alias("classifier"), "l_quantity"
    )
    return rows.groupBy("classifier").agg(F.round(F.avg("l_quantity"), 6).alias("clf_ms"))


@query(
    "j4_total_time",
    twin(
        """SELECT model, classifier, accuracy, f1, clf_ms, CASE WHEN model = 'm3' THEN NULL ELSE time_ms END AS time_ms,
        round(CASE WHEN model = 'm3' THEN NULL ELSE time_ms END + clf_ms, 6) AS total_ms
        FROM summ JOIN ctimes USING (classifier) LEFT JOIN times USING (model)""",
        "summ",
        "times",
        "ctimes",
    ),
)
def j4(spark, d):
    full = summary(spark, d).join(classifier_times(spark, d), "classifier")
    out = leaderboard.with_total_time(full, model_times(spark, d).where("model <> 'm3'"))
    return out.withColumn("total_ms", F.round("total_ms", 6))


@query(
    "j5_predictions_with_metadata",
    twin(
        """SELECT model, classifier, item_id, y_true, y_pred, genus, family, score, category FROM preds LEFT JOIN sps ON species = y_true
        WHERE model = 'm1'""",
        "preds",
        "sps",
    ),
)
def j5(spark, d):
    meta = species_table(spark, d).withColumnRenamed("species", "y_true")
    return predictions(spark, d).where("model = 'm1'").join(meta, "y_true", "left")


@query(
    "j6_taxonomy_both_sides",
    twin(
        """SELECT model, classifier, y_true, y_pred, n, t.genus AS genus_true, p.genus AS genus_pred, t.family AS family_true,
        p.family AS family_pred, tc_true AS tclass_true, tc_pred AS tclass_pred
        FROM graded LEFT JOIN sps t ON t.species = y_true LEFT JOIN sps p ON p.species = y_pred""",
        "graded",
        "sps",
    ),
)
def j6(spark, d):
    return taxonomy.with_taxonomy(cells(spark, d), species_table(spark, d), classes(spark))


@query(
    "j9_pairs_to_run",
    twin(
        """SELECT g.model, g.classifier FROM (SELECT DISTINCT model, classifier FROM preds) g
        WHERE NOT EXISTS (SELECT 1 FROM summ s WHERE s.model = g.model AND s.classifier = g.classifier AND s.accuracy > 0.66)""",
        "preds",
        "summ",
    ),
)
def j9(spark, d):
    done = summary(spark, d).where("accuracy > 0.66")
    wanted = predictions(spark, d).select("model", "classifier").distinct()
    return leaderboard.pending_pairs(wanted, done)


@query(
    "p8_exclude_patterns",
    twin("SELECT * FROM summ WHERE lower(model) NOT LIKE '%\\_gap%' ESCAPE '\\' AND lower(classifier) NOT LIKE '%faiss%'", "summ"),
)
def p8(spark, d):
    return summary(spark, d).where(leaderboard.lacks("model", "_gap") & leaderboard.lacks("classifier", "faiss"))


@query(
    "p7_canonical_columns",
    twin('SELECT model AS "Embedding Model", classifier AS "Classifier", f1 AS "F1_Macro", accuracy AS "Accuracy" FROM summ', "summ"),
)
def p7(spark, d):
    raw = summary(spark, d).withColumnsRenamed(
        {"model": "Embedding Model", "classifier": "Classifier", "f1": "F1 Score Macro", "accuracy": "Accuracy"}
    )
    return leaderboard.canonical_columns(raw)


@query(
    "p29_rounding_policy",
    twin(
        """SELECT model, classifier, round(accuracy, 4) AS accuracy, round(f1, 4) AS f1, round(time_ms, 1) AS time_ms
        FROM summ JOIN times USING (model)""",
        "summ",
        "times",
    ),
)
def p29(spark, d):
    return leaderboard.rounded(summary(spark, d).join(model_times(spark, d), "model"), ["time_ms"])


@query(
    "p30_architecture_pooling",
    twin(
        """SELECT model, classifier, replace(replace(model, '_gap', ''), '_cls', '') AS architecture,
        CASE WHEN contains(model, 'gap') THEN 'GAP' ELSE 'CLS' END AS pooling FROM summ""",
        "summ",
    ),
)
def p30(spark, d):
    return leaderboard.architecture(summary(spark, d)).select("model", "classifier", "architecture", "pooling")


@query(
    "l5_custom_order",
    twin(
        """SELECT category, row_number() OVER (ORDER BY coalesce(list_position(['Crítico', 'Alto', 'Medio', 'Bajo', 'Nulo'], category), 6), category) AS position
        FROM (SELECT DISTINCT category FROM catc)""",
        "catc",
    ),
)
def l5(spark, d):
    names = category_counts(spark, d).select("category").distinct()
    return leaderboard.custom_order(names, "category", taxonomy.CATEGORY_ORDER)


@query(
    "a30_classifier_latency",
    "SELECT l_returnflag || l_linestatus AS classifier, round(avg(l_extendedprice / 1000), 6) AS mean_ms FROM lineitem GROUP BY 1",
)
def a30(spark, d):
    return leaderboard.mean_latency(_timings(spark, d)).select("classifier", *r6("mean_ms"))


def _timings(spark, d):
    return base.table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("classifier"),
        (F.col("l_extendedprice") / 1000).alias("ms"),
    )


@query(
    "a31_latency_summary",
    """SELECT l_returnflag || l_linestatus AS classifier, round(avg(l_extendedprice / 1000), 6) AS mean_ms,
    round(median(l_extendedprice / 1000), 6) AS median_ms, round(quantile_cont(l_extendedprice / 1000, 0.95), 6) AS p95_ms FROM lineitem GROUP BY 1""",
)
def a31(spark, d):
    return leaderboard.latency_summary(_timings(spark, d)).select("classifier", *r6("mean_ms", "median_ms", "p95_ms"))


cte(
    "cat3",
    """SELECT model, classifier, category, sum(Correct)::BIGINT AS Correct, sum(Incorrect)::BIGINT AS Incorrect FROM (
      SELECT * FROM catc UNION ALL SELECT model, classifier, 'Medio+Bajo', Correct, Incorrect FROM catc WHERE category IN ('Medio', 'Bajo'))
    WHERE lower(classifier) NOT LIKE '%faiss%' GROUP BY ALL""",
    "catc",
)
cte("cacc", "SELECT *, Correct / (Correct + Incorrect)::DOUBLE * 100 AS acc FROM cat3", "cat3")


def category_accuracy(spark, d):
    counts = taxonomy.with_combined(category_counts(spark, d))
    kept = counts.where(leaderboard.lacks("classifier", "faiss"))
    total = kept.groupBy("model", "classifier", "category").agg(
        F.sum("Correct").alias("Correct"), F.sum("Incorrect").alias("Incorrect")
    )
    return total.withColumn("acc", F.col("Correct") / (F.col("Correct") + F.col("Incorrect")) * 100)


@query(
    "a32_dispersion",
    twin(
        """SELECT model, category, round(min(acc), 6) AS disp_min, round(max(acc), 6) AS disp_max, round(max(acc) - min(acc), 6) AS disp_range,
        round(coalesce(stddev_samp(acc), 0), 6) AS disp_std, arg_min(classifier, struct_pack(a := acc, c := classifier)) AS disp_min_classifier,
        arg_min(classifier, struct_pack(a := -acc, c := classifier)) AS disp_max_classifier FROM cacc GROUP BY model, category""",
        "cacc",
    ),
)
def a32(spark, d):
    out = leaderboard.dispersion(category_accuracy(spark, d), ["model", "category"], "acc")
    return out.withColumns({c: F.round(c, 6) for c in ("disp_min", "disp_max", "disp_range", "disp_std")})


@query(
    "a33_mean_of_classifiers",
    twin(
        """SELECT model, category, round(avg(acc), 6) AS mean_accuracy, (sum(Correct + Incorrect) / count(*))::BIGINT AS n_images, any_value(n_species) AS n_species
        FROM cacc JOIN (SELECT category, count(*) AS n_species FROM (SELECT DISTINCT CASE WHEN category IN ('Doméstica', 'Exótica/Invasora') THEN 'Nulo' ELSE category END AS category, y_true
            FROM cells JOIN sps ON species = y_true UNION SELECT 'Medio+Bajo', y_true FROM cells JOIN sps ON species = y_true WHERE category IN ('Medio', 'Bajo')) GROUP BY 1)
        USING (category) GROUP BY model, category""",
        "cacc",
        "sps",
        "cells",
    ),
)
def a33(spark, d):
    species = taxonomy.with_combined(collapsed_species(spark, d))
    seen = cells(spark, d).select(F.col("y_true").alias("species")).distinct()
    n_species = species.join(seen, "species").groupBy("category").agg(
        F.count_distinct("species").alias("n_species")
    )
    means = category_accuracy(spark, d).groupBy("model", "category").agg(
        F.round(F.avg("acc"), 6).alias("mean_accuracy"),
        F.max(F.col("Correct") + F.col("Incorrect")).alias("n_images"),
    )
    return means.join(n_species, "category")


@query(
    "a44_status_shares",
    twin(
        """SELECT model, classifier, category, status, count, CASE WHEN total > 0 THEN round(count / total::DOUBLE * 100, 6) ELSE 0 END AS percentage FROM (
          SELECT *, sum(count) OVER (PARTITION BY model, classifier, category) AS total FROM (
            SELECT model, classifier, category, 'Correct' AS status, Correct AS count FROM catc
            UNION ALL SELECT model, classifier, category, 'Incorrect', Incorrect FROM catc))""",
        "catc",
    ),
)
def a44(spark, d):
    shares = taxonomy.status_shares(category_counts(spark, d), ["model", "classifier"])
    return shares.withColumn("percentage", F.round("percentage", 6))


# --- set operations -------------------------------------------------------------------


@query(
    "u1_stack",
    twin("SELECT 'accuracy' AS metric, model, classifier, accuracy AS value FROM summ UNION ALL SELECT 'f1', model, classifier, f1 FROM summ", "summ"),
)
def u1(spark, d):
    rows = materialize(summary(spark, d))
    parts = [rows.select(F.lit(m).alias("metric"), "model", "classifier", F.col(m).alias("value")) for m in ("accuracy", "f1")]
    return parts[0].unionByName(parts[1])


@query("u2_union", twin("SELECT model FROM best UNION SELECT model FROM times", "best", "times"))
def u2(spark, d):
    return summary(spark, d).select("model").union(model_times(spark, d).select("model")).distinct()


@query(
    "u3_distinct",
    "SELECT p_brand, min(p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY p_brand",
)
def u3(spark, d):
    return leaderboard.first_per_key(base.table(spark, d, "part").select("p_brand", "p_partkey", "p_name"), ["p_brand"], "p_partkey")


@query(
    "u4_difference",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
)
def u4(spark, d):
    done = base.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return base.table(spark, d, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query(
    "u5_alignment",
    twin(
        """SELECT model, count(*) FILTER (bad) AS mismatches, count(*) FILTER (bad) = 0 AS aligned FROM (
          SELECT p.model, p.item_id, CASE WHEN p.model = 'm2_gap' AND p.y_true = 'sp3' THEN 'sp4' ELSE p.y_true END <> r.y_true AS bad
          FROM (SELECT DISTINCT model, item_id, y_true FROM preds) p JOIN (SELECT DISTINCT item_id, y_true FROM preds WHERE model = 'm1') r USING (item_id))
        GROUP BY model""",
        "preds",
    ),
)
def u5(spark, d):
    rows = predictions(spark, d).select("model", "item_id", "y_true").distinct()
    moved = rows.withColumn(
        "y_true", F.when((F.col("model") == "m2_gap") & (F.col("y_true") == "sp3"), "sp4").otherwise(F.col("y_true"))
    )
    return leaderboard.alignment(moved, "m1")


# --- bootstrap -------------------------------------------------------------------------

ITERATIONS = 1_000

cte(
    "joint",
    """SELECT item_id, y_true, string_agg(model || '|' || classifier || '=' || y_pred, ',' ORDER BY model || '|' || classifier) AS cell FROM preds
    GROUP BY item_id, y_true""",
    "preds",
)
cte(
    "placed",
    """SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY md5(cell), cell, item_id) - 1 AS slot, count(*) OVER (PARTITION BY y_true) AS n_class FROM joint""",
    "joint",
)
cte(
    "draws",
    f"""SELECT iteration, y_true, ('0x' || substr(md5('29~' || iteration || '~' || y_true || '~' || slot), 1, 8))::BIGINT % n_class AS pos
    FROM placed, (SELECT unnest(range({ITERATIONS})) AS iteration)""",
    "placed",
)
cte(
    "drawn",
    "SELECT d.iteration, d.y_true, t.item_id FROM draws d JOIN placed t ON t.y_true = d.y_true AND t.slot = d.pos",
    "draws",
)
cte(
    "bcells",
    """SELECT iteration, p.model || '|' || p.classifier AS series, d.y_true, p.y_pred, count(*) AS n FROM drawn d JOIN preds p ON p.item_id = d.item_id AND p.y_true = d.y_true
    GROUP BY ALL""",
    "drawn",
    "preds",
)
# the tree of operators/draws.py: cells numbered in each class, weights of its nodes, splits from the root down
cte(
    "tcell",
    "SELECT y_true, cell, count(*) AS n, row_number() OVER (PARTITION BY y_true ORDER BY md5(cell), cell) - 1 AS place FROM joint GROUP BY y_true, cell",
    "joint",
)
cte(
    "tnode",
    """SELECT y_true, h, (place >> h) AS p, sum(n)::BIGINT AS w FROM tcell, (SELECT unnest(range(
      (SELECT greatest(1, length(bin(max(place)))) FROM tcell) + 1))::INTEGER AS h) GROUP BY ALL""",
    "tcell",
)
_MIXED = "xor({x}_4, {x}_4 >> 16)"


def _mixing(x: str, start: str) -> str:
    """Columns x_0 to x_4 of the 32-bit mixing of ``draws.mixed``; its result is ``_MIXED``."""
    m1, m2 = draws.MULTIPLIERS
    return f"""{start} AS {x}_0, xor({x}_0, {x}_0 >> 16) AS {x}_1, ({x}_1 * {m1}::UBIGINT) & 4294967295::UBIGINT AS {x}_2,
      xor({x}_2, {x}_2 >> 13) AS {x}_3, ({x}_3 * {m2}::UBIGINT) & 4294967295::UBIGINT AS {x}_4"""


cte(
    "tsplit",
    f"""SELECT y_true, h, p, a, b, ('0x' || substr(s, 1, 8))::UBIGINT AS s1, ('0x' || substr(s, 9, 8))::UBIGINT AS s2
    FROM (SELECT l.y_true, l.h + 1 AS h, l.p >> 1 AS p, l.w AS a, coalesce(r.w, 0) AS b,
      md5('29~' || l.y_true || '~' || (l.h + 1) || '~' || (l.p >> 1)) AS s
      FROM tnode l LEFT JOIN tnode r ON r.y_true = l.y_true AND r.h = l.h AND r.p = l.p + 1 WHERE l.p % 2 = 0)""",
    "tnode",
)
cte(
    "titer",
    f"""SELECT iteration, {_MIXED.format(x='t')} AS turn FROM (SELECT iteration, {_mixing('t', '(iteration + 1)::UBIGINT')}
      FROM (SELECT unnest(range({ITERATIONS})) AS iteration))""",
)
_UP = "s.up * (((m - (mode + (i - 1))) * a) / ((mode + (i - 1) + 1.0::DOUBLE) * b))"
_DOWN = "s.down * (((mode - (i - 1)) * b) / ((m - (mode - (i - 1)) + 1.0::DOUBLE) * a))"
_WALK = f"""list_reduce(range(1, steps + 1), lambda s, i: {{{{'up': {_UP}, 'down': {_DOWN}, {{rest}}}}}},
  {{{{'up': 1.0::DOUBLE, 'down': 1.0::DOUBLE, {{start}}}}}})"""
_TOTAL = _WALK.format(rest=f"'sums': (s.sums + {_UP}) + {_DOWN}", start="'sums': 1.0::DOUBLE")
_PICK = _WALK.format(
    rest=f"""'sums': (s.sums + {_UP}) + {_DOWN},
  'pick': CASE WHEN s.pick IS NOT NULL THEN s.pick WHEN s.sums + {_UP} > goal THEN mode + i WHEN (s.sums + {_UP}) + {_DOWN} > goal THEN mode - i END""",
    start="'sums': 1.0::DOUBLE, 'pick': CASE WHEN 1.0::DOUBLE > goal THEN mode END",
)
cte(
    "tdraw",
    f"""WITH RECURSIVE walk AS (
      SELECT iteration, turn, y_true, h, p, w AS m FROM titer, tnode WHERE h = (SELECT max(h) FROM tnode)
      UNION ALL
      SELECT iteration, turn, y_true, h - 1, unnest([2 * p, 2 * p + 1]), unnest([k, m - k]) FROM (
        SELECT * EXCLUDE (m), m::BIGINT AS m, CASE WHEN b = 0 THEN m ELSE ({_PICK}).pick END::BIGINT AS k FROM (
          SELECT *, ((high * 1048576::UBIGINT + (low >> 12))::DOUBLE / 4503599627370496::DOUBLE) * CASE WHEN b = 0 THEN 0 ELSE ({_TOTAL}).sums END AS goal FROM (
            SELECT iteration, turn, y_true, h, p, m, a, b, {_MIXED.format(x='x')} AS high, {_MIXED.format(x='y')} AS low,
              least(m, floor((m + 1.0::DOUBLE) * a / (a + b))) AS mode,
              CASE WHEN b = 0 THEN 0 ELSE least(m, ceil(10.0::DOUBLE * sqrt(m * a * b) / (a + b)) + 20.0::DOUBLE) END::BIGINT AS steps FROM (
              SELECT iteration, turn, y_true, h, p, m::DOUBLE AS m, a::DOUBLE AS a, b::DOUBLE AS b,
                {_mixing('x', 'xor(s1, turn)')}, {_mixing('y', 'xor(s2, turn)')}
              FROM walk JOIN tsplit USING (y_true, h, p) WHERE m > 0)))))
    SELECT iteration, y_true, p AS place, m AS times FROM walk WHERE h = 0 AND m > 0""",
    "titer",
    "tnode",
    "tsplit",
)
cte(
    "tcells",
    """SELECT iteration, series, y_true, y_pred, sum(times)::BIGINT AS n FROM tdraw JOIN tcell USING (y_true, place)
    JOIN (SELECT DISTINCT j.y_true, j.cell, p.model || '|' || p.classifier AS series, p.y_pred FROM joint j JOIN preds p USING (item_id, y_true)) USING (y_true, cell)
    GROUP BY ALL""",
    "tdraw",
    "tcell",
    "joint",
    "preds",
)
_SCORES = """SELECT iteration, series, 'accuracy' AS metric, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) / sum(n)::DOUBLE AS value FROM {t} GROUP BY ALL
    UNION ALL SELECT iteration, series, 'f1', avg(2 * tp::DOUBLE / (n_true + n_pred)) FROM (
      SELECT iteration, series, label, sum(nt) AS n_true, sum(np) AS n_pred, sum(tp) AS tp FROM (
        SELECT iteration, series, y_true AS label, n AS nt, 0 AS np, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp FROM {t}
        UNION ALL SELECT iteration, series, y_pred, 0, n, 0 FROM {t}) GROUP BY ALL) WHERE n_true > 0 GROUP BY iteration, series"""
cte("bscores", _SCORES.format(t="bcells"), "bcells")
cte("tscores", _SCORES.format(t="tcells"), "tcells")
_CI = """SELECT {by}, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS ci_lower,
  round(quantile_cont(value, 0.975), 6) AS ci_upper, round(quantile_cont(value, 0.975) - quantile_cont(value, 0.025), 6) AS ci_width FROM {t} GROUP BY {by}"""


def _rounded_ci(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "ci_lower", "ci_upper", "ci_width")})


def joint(spark, d):
    return materialize(bootstrap.joint_cells(predictions(spark, d), ["model", "classifier"]))


def _cells_of(spark, d):
    return bootstrap.hash_cells(joint(spark, d), ITERATIONS, 29)


def _scores(spark, d):
    return bootstrap.iteration_scores(materialize(_cells_of(spark, d)))


@query("b1_bootstrap_ci", twin(_CI.format(by="series, metric", t="bscores"), "bscores"))
def b1(spark, d):
    scores = _scores(spark, d)
    return _rounded_ci(bootstrap.interval(scores, ["series", "metric"]))


def _tree_cells(spark, d):
    return bootstrap.tree_cells(joint(spark, d), ITERATIONS, 29)


def _tree_scores(spark, d):
    return bootstrap.iteration_scores(materialize(_tree_cells(spark, d)))


@query("b1_bootstrap_multinomial", twin(_CI.format(by="series, metric", t="tscores"), "tscores"))
def b1_multinomial(spark, d):
    """A thousand iterations drawn through a tree of cells, not item by item."""
    return _rounded_ci(bootstrap.interval(_tree_scores(spark, d), ["series", "metric"]))


@query(
    "b2_paired_difference",
    twin(
        """SELECT iteration, metric, round(max(CASE WHEN series = 'm1|Linear SVM' THEN value END) - max(CASE WHEN series = 'm1|KNN (k=1)' THEN value END), 6) AS difference
        FROM tscores GROUP BY iteration, metric""",
        "tscores",
    ),
)
def b2(spark, d):
    """Difference of two classifiers on the same resamples."""
    scores = _tree_scores(spark, d)
    pick = lambda s: F.max(F.when(F.col("series") == s, F.col("value")))
    return scores.groupBy("iteration", "metric").agg(
        F.round(pick("m1|Linear SVM") - pick("m1|KNN (k=1)"), 6).alias("difference")
    )


cte(
    "catv",
    """SELECT iteration, category, avg(acc) AS value FROM (
      SELECT iteration, series, category, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) / sum(n)::DOUBLE * 100 AS acc FROM (
        SELECT b.*, CASE WHEN category IN ('Doméstica', 'Exótica/Invasora') THEN 'Nulo' ELSE category END AS category FROM tcells b JOIN sps ON species = y_true
        UNION ALL SELECT b.*, 'Medio+Bajo' FROM tcells b JOIN sps ON species = y_true WHERE category IN ('Medio', 'Bajo')) GROUP BY ALL) GROUP BY ALL""",
    "tcells",
    "sps",
)


@query("b3_bootstrap_by_category", twin(_CI.format(by="category", t="catv"), "catv"))
def b3(spark, d):
    dim = taxonomy.with_combined(collapsed_species(spark, d)).select(
        F.col("species").alias("y_true"), "category"
    )
    cells_by = _tree_cells(spark, d).join(dim, "y_true")
    by_series = metrics.accuracy(cells_by, ["iteration", "series", "category"])
    values = by_series.groupBy("iteration", "category").agg((F.avg("accuracy") * 100).alias("value"))
    return _rounded_ci(bootstrap.interval(values, ["category"]))


cte("ci", _CI.format(by="series, metric", t="tscores"), "tscores")


@query(
    "b4_forest_table",
    twin(
        """SELECT series, mean, round(mean - ci_lower, 6) AS err_lo, round(ci_upper - mean, 6) AS err_hi, max(mean) OVER () AS best_mean
        FROM ci WHERE metric = 'accuracy'""",
        "ci",
    ),
)
def b4(spark, d):
    scores = _tree_scores(spark, d)
    ci = _rounded_ci(bootstrap.interval(scores.where("metric = 'accuracy'"), ["series", "metric"]))
    return leaderboard.forest_table(ci).select("series", "mean", *r6("err_lo", "err_hi"), "best_mean")


@query(
    "a45_basic_interval",
    twin(
        """SELECT series, round(2 * p.point - ci_upper, 5) AS basic_lower, round(2 * p.point - ci_lower, 5) AS basic_upper, round(mean - p.point, 5) AS bias
        FROM ci JOIN (SELECT model || '|' || classifier AS series, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) / sum(n)::DOUBLE AS point FROM cells GROUP BY ALL) p USING (series)
        WHERE metric = 'accuracy'""",
        "ci",
        "cells",
    ),
)
def a45(spark, d):
    scores = _tree_scores(spark, d)
    ci = _rounded_ci(bootstrap.interval(scores.where("metric = 'accuracy'"), ["series", "metric"]))
    points = metrics.accuracy(metrics.confusion(predictions(spark, d), ["model", "classifier"]), ["model", "classifier"])
    points = points.select(F.concat_ws("|", "model", "classifier").alias("series"), "accuracy")
    lower, upper = bootstrap.basic_interval(F.col("accuracy"), F.col("ci_lower"), F.col("ci_upper"))
    return ci.join(points, "series").select(
        "series",
        F.round(lower, 5).alias("basic_lower"),
        F.round(upper, 5).alias("basic_upper"),
        F.round(F.col("mean") - F.col("accuracy"), 5).alias("bias"),
    )


# --- open set, scalability, incremental cost, grids --------------------------------------


@query(
    "b5_outlier_rate",
    twin(
        """SELECT round(t, 6) AS threshold, round(avg(CASE WHEN d > t THEN 1.0::DOUBLE ELSE 0 END), 6) AS outlier_rate FROM
        (SELECT item_id, min(d) AS d FROM qcp GROUP BY item_id),
        (SELECT quantile_cont(list_distance(g.vn, c.c), 0.95) AS t FROM gal g JOIN centp c USING (species)) GROUP BY t""",
        "qcp",
    ),
)
def b5(spark, d):
    rows = base.split2(spark, d)
    gallery = rows.where("split = 'gallery'")
    means = materialize(centroid.centroids(rows, renormalise=False))
    limit = openset.outlier_threshold(gallery, means)
    near = search.nearest(centroid.normalised(rows.where("split = 'query'")), means, 1, metric="euclidean")
    return near.agg(
        F.round(F.lit(limit), 6).alias("threshold"),
        F.round(F.avg((F.col("distance") > limit).cast("double")), 6).alias("outlier_rate"),
    )


cte(
    "known",
    "SELECT species FROM (SELECT species, row_number() OVER (ORDER BY species) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT species FROM gal)) WHERE r <= floor(n * 0.8::DOUBLE)",
    "gal",
)
cte(
    "bin_open",
    """SELECT t, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 1 AND p = 1) AS tp FROM (
      SELECT t, CASE WHEN species IN (SELECT species FROM known) THEN 0 ELSE 1 END AS y, CASE WHEN d > t THEN 1 ELSE 0 END AS p FROM
      (SELECT item_id, species, min(d) AS d FROM qcp WHERE csp IN (SELECT species FROM known) GROUP BY item_id, species),
      (SELECT quantile_cont(list_distance(g.vn, c.c), 0.95) AS t FROM gal g JOIN centp c USING (species) WHERE g.species IN (SELECT species FROM known))) GROUP BY t""",
    "known",
    "qcp",
)


@query(
    "b6_open_set",
    twin(_BINARY.replace("SELECT tn", "SELECT round(t, 6) AS threshold, tn").replace("FROM bin", "FROM bin_open"), "bin_open"),
)
def b6(spark, d):
    rows = base.split2(spark, d)
    out = openset.open_set(rows.where("split = 'gallery'"), rows.where("split = 'query'"))
    return out.select(*r6("threshold"), "tn", "fp", "fn", "tp", *r6("precision", "recall", "f1", "false_alarm_rate"))


STEPS, REPEATS = [3, 5, 8, 10, 20, 30, 50, 70], 5
_steps = ", ".join(
    [f"({i * REPEATS + r}, {s})" for i, s in enumerate(STEPS) for r in range(REPEATS)]
    + [f"({len(STEPS) * REPEATS}, NULL)"]
)
cte(
    "chosen",
    f"""SELECT subset, coalesce(step, n) AS num_classes, species FROM (SELECT subset, step, species, count(*) OVER (PARTITION BY subset) AS n,
      row_number() OVER (PARTITION BY subset ORDER BY md5('29~' || subset || '~' || species)) AS r FROM (SELECT DISTINCT species FROM gal), (VALUES {_steps}) v(subset, step))
    WHERE step IS NULL OR (step < n AND r <= step)""",
    "gal",
)
cte(
    "scal",
    """SELECT subset, species AS y_true, arg_min(csp, struct_pack(d := d, s := csp)) AS y_pred, min(d) AS d FROM (
      SELECT a.subset, a.num_classes, q.item_id, q.species, q.csp, q.d FROM qcp q JOIN chosen a ON a.species = q.species JOIN chosen b ON b.subset = a.subset AND b.species = q.csp)
    GROUP BY subset, item_id, species""",
    "chosen",
    "qcp",
)
cte("scells", "SELECT subset, y_true, y_pred, count(*) AS n FROM scal GROUP BY ALL", "scal")
cte(
    "slabs",
    """SELECT subset, label, sum(nt) AS n_true, sum(np) AS n_pred, sum(tp) AS tp FROM (
      SELECT subset, y_true AS label, n AS nt, 0 AS np, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp FROM scells
      UNION ALL SELECT subset, y_pred, 0, n, 0 FROM scells) GROUP BY ALL""",
    "scells",
)


@query(
    "b7_scalability",
    twin(
        """SELECT num_classes, floor(avg(n_items))::BIGINT AS samples, round(avg(acc), 6) AS accuracy, round(avg(f1), 6) AS f1, round(avg(p), 6) AS precision,
        round(avg(r), 6) AS recall, round(avg(o), 6) AS outlier_rate FROM (SELECT DISTINCT subset, num_classes FROM chosen) JOIN
        (SELECT subset, count(*) AS n_items, avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0 END) AS acc, avg(CASE WHEN d > t THEN 1.0::DOUBLE ELSE 0 END) AS o
          FROM scal, (SELECT quantile_cont(list_distance(g.vn, c.c), 0.95) AS t FROM gal g JOIN centp c USING (species)) GROUP BY subset) USING (subset) JOIN
        (SELECT subset, avg(2 * tp::DOUBLE / (n_true + n_pred)) AS f1, avg(CASE WHEN n_pred > 0 THEN tp::DOUBLE / n_pred ELSE 0 END) AS p,
          avg(CASE WHEN n_true > 0 THEN tp::DOUBLE / n_true ELSE 0 END) AS r FROM slabs GROUP BY subset) USING (subset) GROUP BY num_classes""",
        "scal",
        "slabs",
    ),
)
def b7(spark, d):
    rows = base.split2(spark, d)
    out = openset.scalability(rows.where("split = 'gallery'"), rows.where("split = 'query'"), STEPS, REPEATS, 29)
    return out.select("num_classes", "samples", *r6("accuracy", "f1", "precision", "recall", "outlier_rate"))


cte(
    "curve",
    """SELECT ['m1', 'm2_gap', 'm3'][o_custkey % 3 + 1] AS model, CASE o_orderstatus WHEN 'F' THEN 5 WHEN 'O' THEN 10 ELSE 20 END AS num_classes,
    round(avg(o_totalprice) / 600000, 6) AS f1 FROM orders GROUP BY 1, 2""",
)


@query(
    "l9_preview_at_max",
    twin("SELECT * FROM curve WHERE num_classes = (SELECT max(num_classes) FROM curve) ORDER BY f1 DESC", "curve"),
)
def l9(spark, d):
    names = F.array(*[F.lit(m) for m in MODELS])
    step = F.when(F.col("o_orderstatus") == "F", 5).when(F.col("o_orderstatus") == "O", 10).otherwise(20)
    curve = (
        base.table(spark, d, "orders")
        .groupBy(F.element_at(names, (F.col("o_custkey") % 3 + 1).cast("int")).alias("model"), step.alias("num_classes"))
        .agg(F.round(F.avg("o_totalprice") / 600000, 6).alias("f1"))
    )
    return leaderboard.at_largest(curve, "num_classes", "f1")


_METRICS = {
    "cosine": "1 - list_inner_product(q.vn, g.vn)",
    "euclidean": "list_distance(q.vec, g.vec)",
    "euclidean_l2norm": "list_distance(q.vn, g.vn)",
    "manhattan": "list_sum(list_transform(list_zip(q.vec, g.vec), lambda p: abs(p[1] - p[2])))",
}
for _model, _vec in (("full", "vec"), ("weighted", "list_transform(vec, lambda x, i: x * (1 + (i - 1) / 16.0::DOUBLE))")):
    cte(
        f"v_{_model}",
        f"""SELECT item_id, species, split, v AS vec, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS vn
        FROM (SELECT * EXCLUDE (vec), {_vec} AS v FROM split2)""",
        "split2",
    )
_grid = " UNION ALL ".join(
    f"""SELECT '{m}' AS model, '{n}' AS metric, avg(CASE WHEN y_pred = species THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM (
      SELECT q.item_id, q.species, arg_min(g.species, struct_pack(d := round({e}, 10), i := g.item_id)) AS y_pred FROM v_{m} q, v_{m} g
      WHERE q.split = 'query' AND g.split = 'gallery' GROUP BY q.item_id, q.species)"""
    for m in ("full", "weighted")
    for n, e in _METRICS.items()
)


@query(
    "b8_distance_grid",
    twin(
        f"SELECT model, metric, round(accuracy, 6) AS accuracy, row_number() OVER (PARTITION BY model ORDER BY round(accuracy, 6) DESC, metric) = 1 AS is_best FROM ({_grid})",
        "v_full",
        "v_weighted",
    ),
)
def b8(spark, d):
    rows = base.split2(spark, d)
    parts = []
    weighted = F.transform("vec", lambda x, i: x * (1 + i / F.lit(16.0)))
    for model, vec in (("full", F.col("vec")), ("weighted", weighted)):
        cut = rows.withColumn("vec", vec)
        near = search.nearest(cut.where("split = 'query'"), cut.where("split = 'gallery'"), 1, metric=tuple(_METRICS))
        hit = (F.col("neighbour") == F.col("species")).cast("double")
        scores = near.agg(*[F.round(F.avg(F.when(F.col("metric") == m, hit)), 6).alias(m) for m in _METRICS])
        lines = [F.struct(F.lit(model).alias("model"), F.lit(m).alias("metric"), F.col(m).alias("accuracy")) for m in _METRICS]
        parts.append(scores.select(F.inline(F.array(*lines))))
    grid = parts[0]
    for part in parts[1:]:
        grid = grid.unionByName(part)
    return leaderboard.flag_best(grid, ["model"], "accuracy", "metric")


cte("votes", _VOTE, "topg")
_B9_PREDS = """SELECT 'Nearest Centroid' AS classifier, item_id, species AS y_true, list(csp ORDER BY d, csp)[1] AS y_pred,
      list_contains(list(csp ORDER BY d, csp)[1:5], species) AS hit FROM qcp GROUP BY item_id, species
    UNION ALL SELECT 'KNN (k=' || k || ')', v.item_id, v.species, y_pred,
      EXISTS (SELECT 1 FROM topg t WHERE t.item_id = v.item_id AND t.rk <= k AND t.gsp = v.species) FROM votes v"""
cte("b9preds", _B9_PREDS, "qcp", "votes", "topg")
# the second model: the first half of each vector
base.clone(["b9preds", "unitall", "means"], "_h", "idx", base.CTES["idx"][0].replace("embedding::", "embedding[1:32]::"))
cte("b9all", "SELECT 'full' AS model, * FROM b9preds UNION ALL SELECT 'half', * FROM b9preds_h", "b9preds", "b9preds_h")
cte(
    "b9labs",
    """SELECT model, classifier, label, sum(t) AS n_true, sum(p) AS n_pred, sum(h) AS tp FROM (
      SELECT model, classifier, y_true AS label, 1 AS t, 0 AS p, (y_true = y_pred)::INT AS h FROM b9all
      UNION ALL SELECT model, classifier, y_pred, 0, 1, 0 FROM b9all) GROUP BY ALL""",
    "b9all",
)
TRAINED = ["Linear SVM", "Random Forest"]


def grid_models(spark, d):
    rows = base.split2(spark, d)
    return {"full": rows, "half": rows.withColumn("vec", F.slice("vec", 1, 32))}


def stored_grid(spark, d):
    """Models and the folder of their grid; a folder of its own for each content of the catalogue."""
    models = grid_models(spark, d)
    mark = models["full"].agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("item_id", "species", "split", "vec")), F.lit(0)).alias("h")
    ).first()
    path = f"{shared_root(spark)}/grid-{mark['n']}-{mark['h'] & (1 << 64) - 1:016x}"
    delete_at_exit(spark, path)
    grid.run_grid(models, path)
    return models, path


@query(
    "b9_classifier_grid",
    twin(
        """SELECT model, classifier, n_items, accuracy, top5, precision, recall, f1 FROM (
          SELECT model, classifier, count(*) AS n_items, round(avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy,
            round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END), 6) AS top5 FROM b9all GROUP BY model, classifier)
        JOIN (SELECT model, classifier, round(avg(CASE WHEN n_pred > 0 THEN tp::DOUBLE / n_pred ELSE 0 END), 6) AS precision,
            round(avg(CASE WHEN n_true > 0 THEN tp::DOUBLE / n_true ELSE 0 END), 6) AS recall,
            round(avg(2 * tp::DOUBLE / (n_true + n_pred)), 6) AS f1 FROM b9labs GROUP BY model, classifier) USING (model, classifier)""",
        "b9all",
        "b9labs",
    ),
)
def b9(spark, d):
    """All classifiers over all models, run or read from the store; the rows that SQL can repeat."""
    _, path = stored_grid(spark, d)
    out = grid.summary(grid.predictions(spark, path)).where(~F.col("classifier").isin(TRAINED))
    return out.select("model", "classifier", "n_items", *r6("accuracy", "top5", "precision", "recall", "f1"))


@query("b9_trained_scores")
def b9_trained(spark, d):
    """The rows of the trained classifiers from the same store."""
    _, path = stored_grid(spark, d)
    out = grid.summary(grid.predictions(spark, path)).where(F.col("classifier").isin(TRAINED))
    return out.select("model", "classifier", "n_items", *r6("accuracy", "top5", "precision", "recall", "f1"))


@query(
    "b9_resumed_grid",
    twin(
        """SELECT model, c AS classifier, n AS n_items, n AS n_distinct, true AS labels_known, true AS top_begins_with_prediction, true AS timed, false AS run_again
        FROM (SELECT count(*) AS n FROM qry), (VALUES ('full'), ('half')) m(model),
          (VALUES ('Nearest Centroid'), ('KNN (k=1)'), ('KNN (k=3)'), ('KNN (k=5)'), ('Linear SVM'), ('Random Forest')) v(c)""",
        "qry",
    ),
)
def b9_resumed(spark, d):
    """Every pair is stored whole, and a second call over the store runs nothing."""
    models, path = stored_grid(spark, d)
    again = grid.run_grid(models, path)
    known = models["full"].where("split = 'gallery'").select(F.col("species").alias("y_pred"), F.lit(True).alias("_known")).distinct()
    checked = grid.predictions(spark, path).join(lookup(known), "y_pred", "left").groupBy(*grid.PAIR).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.countDistinct("item_id").alias("n_distinct"),
        F.min(F.coalesce("_known", F.lit(False))).alias("labels_known"),
        F.min((F.col("top")[0] == F.col("y_pred")) & F.size("top").between(1, 5)).alias("top_begins_with_prediction"),
    )
    timed = grid.latency(spark, path).select(*grid.PAIR, (F.col("ms_per_item") > 0).alias("timed"))
    pairs = F.array(F.lit(""), *[F.lit(f"{m}/{c}") for m, c in again])
    return checked.join(lookup(timed), grid.PAIR).withColumn("run_again", F.array_contains(pairs, F.concat_ws("/", *grid.PAIR)))


def _space(model, suffix, dim):
    own = lambda text: re.sub(r"\b(unitall|means)\b", rf"\1{suffix}", text)
    return own(f"""SELECT '{model}' AS model, {dim}::BIGINT AS dim, (SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) FROM (
          SELECT item_id, any_value(n) AS n, max(CASE WHEN own THEN s / (n - 1) END) AS a, min(CASE WHEN NOT own THEN s / nc END) AS b FROM (
            SELECT x.item_id, y.species = x.species AS own, sum(1 - list_inner_product(x.vn, y.vn)) AS s, count(*) AS nc, any_value(k.n) AS n
            FROM unitall x, unitall y, (SELECT species, count(*) AS n FROM unitall GROUP BY 1) k
            WHERE k.species = x.species GROUP BY x.item_id, y.species, x.species) GROUP BY item_id)) AS silhouette,
        (SELECT round(avg(r), 6) FROM (SELECT a.species, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM sc{suffix} a JOIN sc{suffix} b ON a.species <> b.species
          GROUP BY a.species)) AS davies_bouldin,
        (SELECT round((between_ss / (k - 1)) / (within_ss / (n - k)), 5) FROM
          (SELECT count(*) AS k, sum(m.n) AS n, sum(m.n * power(list_distance(m.c, g.c), 2)) AS between_ss FROM means m,
            (SELECT list(m ORDER BY pos) AS c FROM (SELECT pos, avg(x) AS m FROM (SELECT unnest(vn) AS x, generate_subscripts(vn, 1) AS pos FROM unitall) GROUP BY pos)) g),
          (SELECT sum(power(list_distance(u.vn, m.c), 2)) AS within_ss FROM unitall u JOIN means m USING (species))) AS calinski_harabasz""")


for _suffix in ("", "_h"):
    cte(
        f"sc{_suffix}",
        f"""SELECT m.species, any_value(m.c) AS c, avg(list_distance(u.vn, m.c)) AS s FROM unitall{_suffix} u JOIN means{_suffix} m USING (species)
        GROUP BY m.species""",
        f"unitall{_suffix}",
        f"means{_suffix}",
    )


@query(
    "b9_space_metrics",
    twin(_space("full", "", 64) + "\nUNION ALL " + _space("half", "_h", 32), "unitall", "means", "sc", "unitall_h", "means_h", "sc_h"),
)
def b9_spaces(spark, d):
    out = grid.space_metrics(grid_models(spark, d))
    return out.select("model", "dim", *r6("silhouette", "davies_bouldin"), F.round("calinski_harabasz", 5).alias("calinski_harabasz"))


@query(
    "x2_own_classifier",
    twin(
        """SELECT item_id, species AS y_true, arg_max(csp, struct_pack(d := d, s := csp)) AS y_pred FROM qc GROUP BY item_id, species""",
        "qc",
    ),
)
def x2(spark, d):
    """A caller's classifier is a function (gallery, queries) -> predictions."""
    from shotline.operators.classifiers import evaluate

    def farthest(gallery, queries):
        cents = centroid.centroids(gallery, gallery_only=False)
        far = search.farthest(queries, cents)
        return far.select("item_id", F.col("species").alias("y_true"), F.col("neighbour").alias("y_pred"))

    out = evaluate(base.split2(spark, d), "full", ["Farthest Centroid"], own={"Farthest Centroid": farthest})
    return out.select("item_id", "y_true", "y_pred")


@query("b10_linear_svm")
def b10(spark, d):
    from shotline.operators.classifiers import evaluate

    return evaluate(base.split2(spark, d), "full", ["Linear SVM"])


@query("b11_random_forest")
def b11(spark, d):
    from shotline.operators.classifiers import evaluate

    return evaluate(base.split2(spark, d), "full", ["Random Forest"])


@query(
    "b10_svm_optimality",
    twin(
        """SELECT species, sum(count(*)) OVER ()::BIGINT AS n_train, count(*) AS n_positive, 1.0::DOUBLE AS objective_at_zero, true AS better_than_zero, true AS optimal,
        (SELECT count(*) FROM qry) AS n_queries, 0::BIGINT AS other_answers FROM gal GROUP BY species""",
        "gal",
        "qry",
    ),
)
def b10_optimality(spark, d):
    """Each plane of the SVM is optimal by sums over the rows, and its weights give the model's answers."""
    from shotline.operators.classifiers import linear_svm, model_labels, svm_labels, svm_optimality, svm_weights, trained

    queries, gallery = base.parts(spark, d)
    model, labels = trained(linear_svm, gallery)
    planes = svm_weights(model, labels, spark)
    given = model_labels(model, labels, queries).select("item_id", F.col("y_pred").alias("_given"))
    answers = svm_labels(queries, planes).join(given, "item_id")
    counts = answers.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y_pred") != F.col("_given")).alias("other")).first()
    out = svm_optimality(gallery, planes)
    return out.select(
        "species", "n_train", "n_positive", "objective_at_zero", (F.col("objective") < F.col("objective_at_zero")).alias("better_than_zero"),
        "optimal", F.lit(counts["n"]).alias("n_queries"), F.lit(counts["other"]).alias("other_answers"),
    )


@query(
    "b11_forest_votes",
    twin(
        "SELECT item_id, species AS y_true, 100::BIGINT AS trees, 100.0::DOUBLE AS votes, true AS agrees FROM qry",
        "qry",
    ),
)
def b11_votes(spark, d):
    """The forest's answer is the class its hundred trees' leaves add up to."""
    from shotline.operators.classifiers import forest, forest_votes, trained

    queries, gallery = base.parts(spark, d)
    out = forest_votes(*trained(forest, gallery), queries)
    votes = F.round(F.aggregate("votes", F.lit(0.0), lambda s, x: s + x), 6)
    return out.select("item_id", "y_true", "trees", votes.alias("votes"), (F.col("y_pred") == F.col("y_votes")).alias("agrees"))


def final_evaluation(spark, d, names):
    """The final classifiers on the test split: accuracy, Top-5, macro F1 and severity shares."""
    from shotline.operators.classifiers import evaluate

    rows = splits.select_split(base.split3(spark, d), "query_test")
    preds = materialize(evaluate(rows, "full", names, top=True))
    counts = metrics.confusion(preds, ["classifier"])
    top = preds.groupBy("classifier").agg(F.avg(F.array_contains("top", F.col("y_true")).cast("double")).alias("top5"))
    species = rows.select("species", "genus", "family").distinct()
    dim = rows.select("family", "tclass").distinct()
    shares = taxonomy.severity_shares(taxonomy.severity_counts(counts, species, dim, ["classifier"]))
    return (
        metrics.accuracy(counts, ["classifier"])
        .join(top, "classifier")
        .join(metrics.macro_scores(counts, ["classifier"]), "classifier")
        .join(shares, "classifier")
    )


def frozen_threshold(spark, d):
    """The dev percentile frozen and applied to the test split, as one row."""
    rows = materialize(final_distances(spark, d))
    out = materialize(excluded_classes(spark, d))
    dev = calibrate.included(rows.where("split = 'query_dev'"), out, "d_centroid")
    threshold = calibrate.global_percentiles(dev, "d_centroid").first()["p95"]
    return calibrate.frozen_validation(rows.where("split = 'query_test'"), out, threshold)


def with_frozen_threshold(spark, d, scores):
    """The scores with the frozen threshold's columns beside each classifier."""
    frozen = frozen_threshold(spark, d).select(*r6("threshold"), *_STATS, "n_included", "n_excluded").first()  # one row
    return scores.withColumns({name: F.lit(value) for name, value in frozen.asDict().items()})


@query("b12_final_evaluation")
def b12(spark, d):
    return with_frozen_threshold(spark, d, final_evaluation(spark, d, ["Nearest Centroid", "Linear SVM"]))


cte(
    "b12near",
    """SELECT item_id, species, list(csp ORDER BY d, csp)[1:5] AS top FROM (
      SELECT q.item_id, q.species, c.species AS csp, round(list_distance(q.vn, c.c), 10) AS d FROM unit3 q, centp c WHERE q.split = 'query_test') GROUP BY 1, 2""",
    "unit3",
    "centp",
)
cte(
    "b12labs",
    """SELECT label, sum(t) AS n_true, sum(p) AS n_pred, sum(h) AS tp FROM (
      SELECT species AS label, 1 AS t, 0 AS p, (species = top[1])::INT AS h FROM b12near UNION ALL SELECT top[1], 0, 1, 0 FROM b12near) GROUP BY 1""",
    "b12near",
)


@query(
    "b12_centroid_half",
    twin(
        """SELECT 'Nearest Centroid' AS classifier, count(*) AS n_items, round(avg((species = top[1])::INT), 6) AS accuracy,
        round(avg(list_contains(top, species)::INT), 6) AS top5, (SELECT round(avg(2 * tp::DOUBLE / (n_true + n_pred)), 6) FROM b12labs) AS f1,
        any_value(z.threshold) AS threshold, any_value(z.coverage) AS coverage, any_value(z.inter_contamination) AS inter_contamination,
        any_value(z.separation_gap) AS separation_gap, any_value(z.n_included) AS n_included, any_value(z.n_excluded) AS n_excluded
        FROM b12near, frozen z""",
        "b12near",
        "b12labs",
        "frozen",
    ),
)
def b12_centroid(spark, d):
    """The half of the final evaluation that SQL can repeat, the frozen threshold beside it."""
    out = final_evaluation(spark, d, ["Nearest Centroid"]).select("classifier", "n_items", *r6("accuracy", "top5", "f1"))
    return with_frozen_threshold(spark, d, out)


@query(
    "b12_invariants",
    twin(
        """SELECT c AS classifier, n AS n_items, true AS labels_known, true AS top_begins_with_prediction, true AS ranked
        FROM (SELECT count(*) AS n FROM unit3 WHERE split = 'query_test'), (VALUES ('Linear SVM'), ('Nearest Centroid'), ('Random Forest')) v(c)""",
        "unit3",
    ),
)
def b12_invariants(spark, d):
    """What must hold for trained classifiers: every item once, known labels, the prediction first."""
    from shotline.operators.classifiers import evaluate

    rows = splits.select_split(base.split3(spark, d), "query_test")
    preds = evaluate(rows, "full", ["Nearest Centroid", "Linear SVM", "Random Forest"], top=True)
    known = rows.where("split = 'gallery'").select(F.col("species").alias("y_pred"), F.lit(True).alias("_known")).distinct()
    joined = preds.join(lookup(known), "y_pred", "left")
    distinct = F.size(F.array_distinct("top")) == F.size("top")
    return joined.groupBy("classifier").agg(
        F.countDistinct("item_id").alias("n_items"),
        F.min(F.coalesce("_known", F.lit(False))).alias("labels_known"),
        F.min(F.col("top")[0] == F.col("y_pred")).alias("top_begins_with_prediction"),
        F.min(distinct & F.size("top").between(1, 5)).alias("ranked"),
    )


cte(
    "added",
    """SELECT species, least(5, n) AS shots, least(5, n) * 141.66 / 1000 AS seconds, base, cnt FROM (
      SELECT species, count(*) AS n, row_number() OVER (ORDER BY species) AS r, count(*) OVER () AS cnt,
        least(10, greatest(count(*) OVER () - 5, 0)) AS base FROM gal GROUP BY species) WHERE r BETWEEN base + 1 AND base + 5""",
    "gal",
)


@query("b13_incremental_cost", twin("SELECT species, shots, round(seconds, 6) AS seconds FROM added", "added"))
def b13(spark, d):
    out = openset.incremental_cost(base.gallery(spark, d), 141.66)
    return out.select("species", "shots", *r6("seconds"))


@query(
    "b13_incremental_summary",
    twin(
        """SELECT least(any_value(base), any_value(cnt)) AS initial_classes, count(*) AS added_classes, sum(shots)::BIGINT AS shots,
        round(sum(seconds), 6) AS total_seconds, round(avg(seconds), 6) AS seconds_per_class FROM added""",
        "added",
    ),
)
def b13_summary(spark, d):
    out = openset.incremental_summary(base.gallery(spark, d), 141.66)
    return out.select("initial_classes", "added_classes", "shots", *r6("total_seconds", "seconds_per_class"))
