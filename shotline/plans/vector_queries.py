"""Vector functions, centroids, search and cascades."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotline.functions import vectors
from shotline.operators import cascade, centroid, search, splits
from shotline.plans import base
from shotline.plans.base import query, twin
from shotline.session import materialize


def _round(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# --- sources ---------------------------------------------------------------------


@query(
    "s1_index_scan",
    twin("SELECT item_id, species, genus, family, score FROM idx", "idx"),
)
def s1(spark, d):
    return base.index(spark, d).select("item_id", "species", "genus", "family", "score")


@query(
    "s2_embedding_scan",
    """SELECT i.species, count(*) AS n_items, count(e.vec_id) AS n_loaded,
      count(*) - count(e.vec_id) AS n_missing
    FROM (SELECT p_partkey AS item_id, p_brand AS species FROM part) i
    LEFT JOIN embeddings e ON e.vec_id = i.item_id GROUP BY i.species""",
)
def s2(spark, d):
    from shotline.sources.embeddings import load_embeddings

    items = base.table(spark, d, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("species")
    )
    store = base.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec")
    )
    loaded, missing = load_embeddings(items, store)
    per = loaded.select("species", F.lit(1).alias("hit")).unionByName(
        missing.select("species", F.lit(0).alias("hit"))
    )
    return per.groupBy("species").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum("hit").alias("n_loaded"),
        F.sum(1 - F.col("hit")).alias("n_missing"),
    )


# --- vector functions --------------------------------------------------------------

_PAIR = """SELECT a.vec_id AS item_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
base.cte("pair", _PAIR)
base.cte(
    "pairn",
    """SELECT item_id, list_transform(a, lambda x: x / sqrt(list_inner_product(a, a))) AS a,
    list_transform(b, lambda x: x / sqrt(list_inner_product(b, b))) AS b FROM pair""",
    "pair",
)


def _neighbours(spark, d):
    rows = base.table(spark, d, "embeddings")
    nxt = rows.select((F.col("vec_id") - 1).alias("item_id"), vectors.as_double(F.col("embedding")).alias("b"))
    own = rows.select(F.col("vec_id").alias("item_id"), vectors.as_double(F.col("embedding")).alias("a"))
    return own.join(nxt, "item_id")


@query(
    "v1_l2_normalise",
    """SELECT vec_id AS item_id, round(sqrt(list_inner_product(v, v)), 6) AS length_before,
      round(list_inner_product(v, v) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(v, v))), 6) AS length_after,
      round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first_value
    FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + label)) AS v FROM embeddings)""",
)
def v1(spark, d):
    rows = base.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.transform(vectors.as_double(F.col("embedding")), lambda x: x * (1 + F.col("label"))).alias("v"),
    )
    rows = rows.withColumn("u", vectors.unit(F.col("v")))
    return rows.select(
        "item_id",
        F.round(vectors.norm(F.col("v")), 6).alias("length_before"),
        F.round(vectors.norm(F.col("u")), 6).alias("length_after"),
        F.round(F.element_at("u", 1), 6).alias("first_value"),
    )


def _distance(name):
    def run(spark, d):
        pairs = _neighbours(spark, d)
        return pairs.select(
            "item_id", F.round(vectors.DISTANCES[name](F.col("a"), F.col("b")), 6).alias("distance")
        )

    return run


query(
    "v2_cosine",
    twin("SELECT item_id, round(1 - list_inner_product(a, b), 6) AS distance FROM pairn", "pairn"),
)(_distance("cosine"))
query(
    "v3_euclidean",
    twin("SELECT item_id, round(list_distance(a, b), 6) AS distance FROM pair", "pair"),
)(_distance("euclidean"))
query(
    "v4_euclidean_l2norm",
    twin("SELECT item_id, round(list_distance(a, b), 6) AS distance FROM pairn", "pairn"),
)(_distance("euclidean_l2norm"))
query(
    "v5_manhattan",
    twin(
        """SELECT item_id, round(list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))), 6)
        AS distance FROM pair""",
        "pair",
    ),
)(_distance("manhattan"))


def _long(cents):
    return cents.select("species", "n", F.posexplode("vec").alias("pos", "value")).select(
        "species", "n", (F.col("pos") + 1).cast("bigint").alias("pos"), F.round("value", 6).alias("value")
    )


_LONG = """SELECT species, n, generate_subscripts(c, 1) AS pos, round(unnest(c), 6) AS value FROM """


@query("v6_centroids_unit", twin(_LONG + "cent", "cent"))
def v6(spark, d):
    return _long(centroid.centroids(base.split2(spark, d)))


@query("v7_centroids_mean", twin(_LONG + "centp", "centp"))
def v7(spark, d):
    return _long(centroid.centroids(base.split2(spark, d), renormalise=False))


@query(
    "v8_incremental_centroids",
    twin(
        """SELECT species, count(*) AS n, pos, round(sum(x) / count(*), 6) AS value FROM (
          SELECT species, vn, unnest(vn) AS x, generate_subscripts(vn, 1) AS pos FROM (
            SELECT * FROM gal WHERE score < 5 UNION ALL
            SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY species ORDER BY item_id) AS rn
              FROM gal WHERE score >= 5) WHERE rn <= 5)) GROUP BY species, pos""",
        "gal",
    ),
)
def v8(spark, d):
    rows = centroid.normalised(base.gallery(spark, d))
    known = centroid.class_sums(rows.where("score < 5"))
    added = centroid.class_sums(splits.first_shots(rows.where("score >= 5"), 5))
    merged = centroid.merge_sums(known, added)
    return _long(centroid.as_gallery(merged, renormalise=False))


@query(
    "v9_centroid_source",
    twin(
        """SELECT species, n AS n_all, pos, round(value, 6) AS value FROM (
          SELECT species, pos, avg(x) AS value, count(*) AS n FROM (
            SELECT species, unnest(vn) AS x, generate_subscripts(vn, 1) AS pos FROM unit2)
          GROUP BY species, pos)""",
        "unit2",
    ),
)
def v9(spark, d):
    cents = centroid.centroids(base.split2(spark, d), renormalise=False, gallery_only=False)
    return _long(cents).withColumnRenamed("n", "n_all")


# --- joins and search ----------------------------------------------------------------


@query(
    "j11_nn1",
    twin(
        """SELECT item_id, species, arg_min(gid, struct_pack(d := d, gid := gid)) AS neighbour_id,
        arg_min(gsp, struct_pack(d := d, gid := gid)) AS y_pred, round(min(d), 6) AS distance
        FROM qg GROUP BY item_id, species""",
        "qg",
    ),
)
def j11(spark, d):
    near = search.nearest(*base.parts(spark, d), 1)
    return near.select(
        "item_id", "species", "neighbour_id", F.col("neighbour").alias("y_pred"), *_round("distance")
    )


_TOPK = "SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY d, gid) AS rk FROM qg"
base.cte("topg", _TOPK, "qg")


@query(
    "j12_topk",
    twin(
        "SELECT item_id, rk AS rank, gid AS neighbour_id, gsp AS neighbour, round(d, 6) AS distance FROM topg WHERE rk <= 5",
        "topg",
    ),
)
def j12(spark, d):
    near = search.nearest(*base.parts(spark, d), 5)
    return near.select(
        "item_id", F.col("rank").cast("bigint").alias("rank"), "neighbour_id", "neighbour", *_round("distance")
    )


@query(
    "j12_topk_blocked",
    twin(
        "SELECT item_id, rk AS rank, gid AS neighbour_id, gsp AS neighbour, round(d, 6) AS distance FROM topg WHERE rk <= 3",
        "topg",
    ),
)
def j12_blocked(spark, d):
    """The two-sided block plan, forced by a zero broadcast limit."""
    near = search.nearest(
        *base.parts(spark, d), 3, broadcast_rows=0, block_rows=256
    )
    return near.select(
        "item_id", F.col("rank").cast("bigint").alias("rank"), "neighbour_id", "neighbour", *_round("distance")
    )


_VOTE = """SELECT k, item_id, species, arg_min(gsp, struct_pack(n := -n, s := gsp)) AS y_pred FROM (
  SELECT k, item_id, species, gsp, count(*) AS n FROM topg, (SELECT unnest([1, 3, 5]) AS k)
  WHERE rk <= k GROUP BY k, item_id, species, gsp) GROUP BY k, item_id, species"""


@query("j13_knn_vote", twin(_VOTE, "topg"))
def j13(spark, d):
    near = search.nearest(*base.parts(spark, d), 5)
    return cascade.majority_vote(near, [1, 3, 5])


@query(
    "j14_topk_labels",
    twin(
        """SELECT item_id, array_to_string(list_concat(u, list_transform(range(5 - len(u)), lambda i: u[-1])), ',') AS labels
        FROM (SELECT item_id, list(gsp ORDER BY first_rk) AS u FROM (
          SELECT item_id, gsp, min(rk) AS first_rk FROM topg WHERE rk <= 5 GROUP BY item_id, gsp) GROUP BY item_id)""",
        "topg",
    ),
)
def j14(spark, d):
    near = search.nearest(*base.parts(spark, d), 5)
    return cascade.ranked_labels(near, 5).select(
        "item_id", F.array_join("labels", ",").alias("labels")
    )


base.cte(
    "topc",
    "SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY d, csp) AS rk FROM qc",
    "qc",
)


@query(
    "j15_nearest_centroid",
    twin(
        "SELECT item_id, species, rk AS rank, csp AS label, round(d, 6) AS distance FROM topc WHERE rk <= 5",
        "topc",
    ),
)
def j15(spark, d):
    near = search.nearest(*base.centroid_parts(spark, d), 5)
    return near.select(
        "item_id",
        "species",
        F.col("rank").cast("bigint").alias("rank"),
        F.col("neighbour").alias("label"),
        *_round("distance"),
    )


@query(
    "j15_nearest_mean_centroid",
    twin(
        """SELECT item_id, species, arg_min(csp, struct_pack(d := d, s := csp)) AS y_pred, round(min(d), 6) AS distance
        FROM qcp GROUP BY item_id, species""",
        "qcp",
    ),
)
def j15_mean(spark, d):
    near = search.nearest(
        *base.mean_parts(spark, d), 1, metric="euclidean"
    )
    return near.select("item_id", "species", F.col("neighbour").alias("y_pred"), *_round("distance"))


@query(
    "j16_intra_inter",
    twin(
        """SELECT item_id, species, round(min(CASE WHEN gsp = species THEN d END), 6) AS d_same,
        round(min(CASE WHEN gsp <> species THEN d END), 6) AS d_other FROM qg GROUP BY item_id, species""",
        "qg",
    ),
)
def j16(spark, d):
    out = search.label_minima(*base.parts(spark, d))
    return out.select("item_id", "species", *_round("d_same", "d_other"))


@query(
    "j17_own_centroid",
    twin(
        """SELECT q.item_id, q.species, round(1 - list_inner_product(q.vn, c.c), 6) AS d_centroid
        FROM qry q LEFT JOIN (SELECT * FROM cent WHERE species <> 'sp3') c ON c.species = q.species""",
        "qry",
        "cent",
    ),
)
def j17(spark, d):
    rows, cents = base.centroid_parts(spark, d)
    out = cascade.own_centroid_distance(rows, cents.where("species <> 'sp3'"))
    return out.select("item_id", "species", *_round("d_centroid"))


@query(
    "j18_other_centroid",
    twin(
        "SELECT item_id, species, round(min(d), 6) AS d_other FROM qc WHERE csp <> species GROUP BY item_id, species",
        "qc",
    ),
)
def j18(spark, d):
    out = search.label_minima(*base.centroid_parts(spark, d))
    return out.select("item_id", "species", *_round("d_other"))


@query(
    "j19_gallery_distance",
    twin("SELECT item_id, round(min(d), 6) AS distance FROM qg GROUP BY item_id", "qg"),
)
def j19(spark, d):
    near = search.nearest(*base.parts(spark, d), 1)
    return near.select("item_id", *_round("distance"))


_WEIGHTED = """SELECT item_id, species, arg_min(gsp, struct_pack(w := -w, s := gsp)) AS y_pred, round(max(w), 6) AS weight
  FROM (SELECT item_id, species, gsp, round(sum(1 / (d + 1e-6)), 8) AS w FROM topg WHERE rk <= 5
  GROUP BY item_id, species, gsp) GROUP BY item_id, species"""


@query("j20_weighted_knn", twin(_WEIGHTED, "topg"))
def j20(spark, d):
    near = search.nearest(*base.parts(spark, d), 5)
    return cascade.weighted_vote(near).select("item_id", "species", "y_pred", *_round("weight"))


CONFIDENT, REJECTED = 0.76, 0.86

base.cte("arb", _WEIGHTED, "topg")
base.cte(
    "casc",
    f"""SELECT b.item_id, b.species, b.best, b.d, b.tops, CASE WHEN b.d <= {CONFIDENT} THEN 'alta'
      WHEN b.d >= {REJECTED} THEN 'rechazado' ELSE 'baja' END AS level, arb.y_pred AS arb
    FROM (SELECT item_id, species, arg_min(csp, rk) AS best, min(d) AS d,
      list(csp ORDER BY rk) FILTER (rk <= 5) AS tops FROM topc GROUP BY item_id, species) b
    LEFT JOIN arb USING (item_id)""",
    "topc",
    "arb",
)


@query(
    "j21_cascade",
    twin(
        """SELECT item_id, species AS y_true, CASE WHEN level = 'baja' THEN arb ELSE best END AS y_pred, level,
        round(d, 6) AS distance, CASE level WHEN 'alta' THEN 'BioCLIP' WHEN 'rechazado' THEN 'Rechazo' ELSE 'KNN' END AS decisor,
        CASE WHEN level = 'baja' AND NOT list_contains(tops, arb) THEN arb || ',' ELSE '' END || array_to_string(tops, ',') AS candidates
        FROM casc""",
        "casc",
    ),
)
def j21(spark, d):
    rows, gallery = base.parts(spark, d)
    cents = materialize(centroid.centroids(gallery))
    out = cascade.three_zone(rows, cents, gallery, CONFIDENT, REJECTED)
    names = F.array_join(F.transform("top5", lambda t: t["species"]), ",")
    return out.select(
        "item_id",
        F.col("species").alias("y_true"),
        "y_pred",
        "level",
        F.round("distance", 6).alias("distance"),
        "decisor",
        names.alias("candidates"),
    )


GATE = 0.55


@query(
    "j22_two_stage",
    twin(
        f"""SELECT n.item_id, round(n.d, 6) AS d_gallery, CASE WHEN n.d > {GATE} THEN 'RECHAZADO' ELSE 'PASA' END AS stage1,
        CASE WHEN n.d > {GATE} THEN 'N/A' ELSE c.best END AS predicted,
        CASE WHEN n.d > {GATE} THEN NULL ELSE round(c.d, 6) END AS d_centroid,
        CASE WHEN n.d > {GATE} THEN 'N/A' WHEN c.d > {CONFIDENT} THEN 'BAJA_CONFIANZA' ELSE 'ALTA_CONFIANZA' END AS stage2
        FROM (SELECT item_id, min(d) AS d FROM qg GROUP BY item_id) n JOIN casc c USING (item_id)""",
        "qg",
        "casc",
    ),
)
def j22(spark, d):
    rows, gallery = base.parts(spark, d)
    out = cascade.two_stage(rows, gallery, rows, centroid.centroids(gallery), GATE, CONFIDENT)
    return out.select("item_id", *_round("d_gallery"), "stage1", "predicted", *_round("d_centroid"), "stage2")


@query(
    "x1_pluggable_distance",
    twin(
        "SELECT item_id, round(list_max(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))), 6) AS distance FROM pair",
        "pair",
    ),
)
def x1(spark, d):
    vectors.register_distance(
        "chebyshev", lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    )
    return _distance("chebyshev")(spark, d)


@query(
    "x6_candidates_as_rows",
    twin(
        """SELECT item_id, csp AS species, round(d, 6) AS cosine_distance FROM topc WHERE rk <= 5""",
        "topc",
    ),
)
def x6(spark, d):
    near = search.nearest(*base.centroid_parts(spark, d), 5)
    arrays = cascade.candidate_array(near, 5)
    return arrays.select("item_id", F.inline("top5")).select(
        "item_id", "species", *_round("cosine_distance")
    )


@query(
    "l7_top5_array",
    twin(
        "SELECT item_id, array_to_string(list(csp ORDER BY rk), ',') AS candidates FROM topc WHERE rk <= 5 GROUP BY item_id",
        "topc",
    ),
)
def l7(spark, d):
    near = search.nearest(*base.centroid_parts(spark, d), 5)
    arrays = cascade.candidate_array(near, 5)
    return arrays.select(
        "item_id", F.array_join(F.transform("top5", lambda t: t["species"]), ",").alias("candidates")
    )
