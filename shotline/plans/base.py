"""Query registry, and the tables every query starts from (Spark and SQL forms).

The supplied tables are read as the catalogue, prediction, frame, run and
validation tables of the data model; each derivation exists twice, as a
DataFrame function and as a common table expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotline.operators import centroid, splits

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (body, needs)


def twin(body: str, *needs: str) -> str:
    """SQL text: the needed common table expressions, in order, then ``body``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for inner in CTES[name][1]:
            visit(inner)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body
    heads = ",\n".join(f"{name} AS ({CTES[name][0]})" for name in ordered)
    return f"WITH {heads}\n{body}"


def clone(names: list[str], suffix: str, root: str, body: str) -> None:
    """Define the named common table expressions and what they need once more, with ``root`` replaced by ``body``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for inner in CTES[name][1]:
            visit(inner)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    mentioned = re.compile(r"\b(" + "|".join(ordered) + r")\b")
    for name in ordered:
        text, needs = (body, ()) if name == root else CTES[name]
        if name + suffix not in CTES:
            cte(name + suffix, mentioned.sub(lambda m: m[1] + suffix, text), *[n + suffix for n in needs])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- catalogue of embedded items -------------------------------------------------


def index(spark: SparkSession, folder: str) -> DataFrame:
    label = F.col("label")
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.concat(F.lit("sp"), label).alias("species"),
        F.concat(F.lit("gen"), F.floor(label / 2)).alias("genus"),
        F.concat(F.lit("fam"), F.floor(label / 4)).alias("family"),
        F.concat(F.lit("cls"), F.floor(label / 8)).alias("tclass"),
        (label * 3 % 8).alias("score"),
        F.col("embedding").alias("vec"),
    )


cte(
    "idx",
    """SELECT vec_id AS item_id, 'sp' || label AS species, 'gen' || (label // 2) AS genus,
    'fam' || (label // 4) AS family, 'cls' || (label // 8) AS tclass, (label * 3) % 8 AS score,
    embedding::DOUBLE[] AS vec FROM embeddings""",
)


def split2(spark: SparkSession, folder: str) -> DataFrame:
    return splits.gallery_query(index(spark, folder))


cte(
    "split2",
    """SELECT * EXCLUDE (rk, n), CASE WHEN rk <= CASE WHEN n = 2 THEN 1 WHEN n = 3 THEN 2
      WHEN n >= 5 AND floor(n * 0.2::DOUBLE) < 2 THEN 2
      ELSE greatest(1, floor(n * 0.2::DOUBLE)) END THEN 'gallery' ELSE 'query' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY species ORDER BY md5('29~' || item_id), item_id) AS rk,
      count(*) OVER (PARTITION BY species) AS n FROM idx)""",
    "idx",
)


def split3(spark: SparkSession, folder: str) -> DataFrame:
    return splits.dev_test(split2(spark, folder))


cte(
    "split3",
    """SELECT * EXCLUDE (split) , split FROM split2 WHERE split <> 'query'
    UNION ALL BY NAME
    SELECT * EXCLUDE (split, rk, n), CASE WHEN n > 1 AND rk <= least(n - 1, greatest(1,
      round_even(0.3::DOUBLE * n, 0))) THEN 'query_test' ELSE 'query_dev' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY species ORDER BY md5('30~' || item_id), item_id) AS rk,
      count(*) OVER (PARTITION BY species) AS n FROM split2 WHERE split = 'query')""",
    "split2",
)


def parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Held-out and gallery rows; only the cut rows of the split are stored."""
    rows = split2(spark, folder)
    return rows.where("split = 'query'"), rows.where("split = 'gallery'")


def centroid_parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Held-out rows and unit centroids of the gallery (cosine search)."""
    queries, gallery = parts(spark, folder)
    return queries, centroid.centroids(gallery)


def mean_parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Normalised held-out rows and plain mean centroids (Euclidean search)."""
    queries, gallery = parts(spark, folder)
    return centroid.normalised(queries), centroid.centroids(gallery, renormalise=False)


def gallery(spark: SparkSession, folder: str) -> DataFrame:
    return split2(spark, folder).where("split = 'gallery'")


cte(
    "unit2",
    """SELECT *, CASE WHEN list_inner_product(vec, vec) > 0
      THEN list_transform(vec, lambda x: x / sqrt(list_inner_product(vec, vec))) ELSE vec END AS vn FROM split2""",
    "split2",
)
cte("gal", "SELECT * FROM unit2 WHERE split = 'gallery'", "unit2")
cte("qry", "SELECT * FROM unit2 WHERE split = 'query'", "unit2")
cte(
    "centp",
    """SELECT species, list(m ORDER BY pos) AS c, any_value(n) AS n FROM (
      SELECT species, pos, avg(x) AS m, count(*) AS n FROM (SELECT species, unnest(vn) AS x,
        generate_subscripts(vn, 1) AS pos FROM gal) GROUP BY species, pos) GROUP BY species""",
    "gal",
)
cte(
    "cent",
    """SELECT species, n, CASE WHEN list_inner_product(c, c) > 0
      THEN list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) ELSE c END AS c FROM centp""",
    "centp",
)
cte(
    "qg",
    """SELECT q.item_id, q.species, g.item_id AS gid, g.species AS gsp,
    round(1 - list_inner_product(q.vn, g.vn), 10) AS d FROM qry q, gal g""",
    "qry",
    "gal",
)
cte(
    "qc",
    """SELECT q.item_id, q.species, c.species AS csp, round(1 - list_inner_product(q.vn, c.c), 10) AS d
    FROM qry q, cent c""",
    "qry",
    "cent",
)
cte(
    "qcp",
    """SELECT q.item_id, q.species, c.species AS csp, round(list_distance(q.vn, c.c), 10) AS d
    FROM qry q, centp c""",
    "qry",
    "centp",
)
