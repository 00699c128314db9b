"""Seeded, stratified splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotline.operators.scan import digest, shuffled_rank
from shotline.session import lookup

SEED = 29


def _cut_rows(rows: DataFrame, seed: int, wanted) -> DataFrame:
    """Last row of the first ``wanted(n)`` rows of every species in seeded order.

    Works on ids and labels only. The result has one row per species, so the split
    is then a comparison with it and the wide rows are not shuffled at all.
    """
    ids = shuffled_rank(rows.select("item_id", "species"), ["species"], "item_id", seed, "_rank")
    sizes = rows.groupBy("species").agg(F.count(F.lit(1)).alias("_n"))
    placed = ids.join(sizes, "species").where(F.col("_rank") == wanted(F.col("_n")))
    return placed.select(
        "species", digest(seed, F.col("item_id")).alias("_digest"), F.col("item_id").alias("_item")
    )


def _up_to_cut(seed: int):
    here = F.struct(digest(seed, F.col("item_id")).alias("_digest"), F.col("item_id").alias("_item"))
    return F.coalesce(here <= F.struct("_digest", "_item"), F.lit(False))


def gallery_query(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Assign each item of a species to ``gallery`` or ``query`` (column ``split``).

    A fifth of the class, at least one, at least two from five items on; classes
    of two and three items give one and two. A single item goes to the gallery.
    """

    def wanted(n):
        fifth = F.floor(n * F.lit(0.20))
        return (
            F.when(n == 2, 1)
            .when(n == 3, 2)
            .when((n >= 5) & (fifth < 2), 2)
            .otherwise(F.greatest(F.lit(1), fifth))
        )

    cuts = lookup(_cut_rows(rows, seed, wanted))
    side = F.when(_up_to_cut(seed), "gallery").otherwise("query")
    return rows.join(cuts, "species", "left").select(*rows.columns, side.alias("split"))


def dev_test(rows: DataFrame, seed: int = SEED, fraction: float = 0.3) -> DataFrame:
    """Divide the ``query`` rows into ``query_dev`` and ``query_test``; the rest is kept.

    Test takes the half-even rounded fraction, at least one and never all; a
    class with a single query item stays in dev (see ``dev_test_excluded``).
    """

    def wanted(n):
        share = F.greatest(F.lit(1), F.bround(F.lit(fraction) * n).cast("bigint"))
        return F.when(n > 1, F.least(n - 1, share))

    cuts = lookup(_cut_rows(rows.where(F.col("split") == "query"), seed + 1, wanted))
    side = (
        F.when(F.col("split") != "query", F.col("split"))
        .when(_up_to_cut(seed + 1), "query_test")
        .otherwise("query_dev")
    )
    joined = rows.join(cuts, "species", "left").withColumn("split", side)
    return joined.select(*rows.columns)


def dev_test_excluded(rows: DataFrame) -> DataFrame:
    """Species whose only query item cannot be divided."""
    counts = rows.where(F.col("split") == "query").groupBy("species")
    return (
        counts.agg(F.count(F.lit(1)).alias("query_count"))
        .where(F.col("query_count") == 1)
        .withColumn("reason", F.lit("single_query_item"))
    )


def split_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that break a split rule; empty when the split is sound."""
    both = before.select("item_id", F.col("split").alias("split_before")).join(
        after.select("item_id", F.col("split").alias("split_after")), "item_id", "full_outer"
    )
    ok = F.when(
        F.col("split_before") == "gallery", F.col("split_after") == "gallery"
    ).otherwise(F.col("split_after").isin("query_dev", "query_test"))
    return both.where(~F.coalesce(ok, F.lit(False)))


def select_split(index: DataFrame, chosen: str | None = None) -> DataFrame:
    """Gallery plus one query split; refuses an ambiguous choice."""
    if chosen is None:
        others = [r["split"] for r in index.where("split <> 'gallery'").select("split").distinct().limit(2).collect()]
        if len(others) > 1:
            raise ValueError("several query splits present; name one")
        chosen = others[0] if others else "query"
    return index.where(F.col("split").isin("gallery", chosen))


def relabel_split(index: DataFrame, old: str, new: str) -> DataFrame:
    return index.withColumn(
        "split", F.when(F.col("split") == old, F.lit(new)).otherwise(F.col("split"))
    )


def first_shots(rows: DataFrame, shots: int, order: str = "item_id") -> DataFrame:
    """The first ``shots`` rows of every species."""
    rank = F.row_number().over(Window.partitionBy("species").orderBy(order))
    return rows.withColumn("shot", rank).where(F.col("shot") <= shots)


def forced_sample(
    rows: DataFrame, group: str, item: str, forced: str, limit: int, seed: int = SEED
) -> DataFrame:
    """At most ``limit`` rows per group, always keeping those with the ``forced`` flag."""
    always = rows.where(F.col(forced))
    counts = always.groupBy(group).agg(F.count(F.lit(1)).alias("_kept"))
    order = Window.partitionBy(group).orderBy("_digest", item)
    fill = (
        rows.where(~F.col(forced))
        .withColumn("_digest", digest(seed, F.col(item)))
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= limit)
        .join(counts, group, "left")
        .where(F.col("_rank") <= limit - F.coalesce("_kept", F.lit(0)))
    )
    return always.unionByName(fill.select(*rows.columns))
