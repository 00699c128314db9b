"""Exact percentiles with linear interpolation over any number of rows.

The built-in ``percentile`` keeps every distinct value of a group in one task.
Here equal values are counted first. A group of more than ``PART`` distinct values is cut by a
bounded sketch, its parts are counted, and only those that contain a wanted rank
are kept; a part that is still too large is cut again in the same way, until no
task sorts more than ``PART`` values. Small groups are sorted at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotline.session import lookup, materialize

HALVES = (128, 64, 32, 16, 8, 4, 2, 1)
CUTS = sum(HALVES)
ACCURACY = 4000
PART = 65_536  # distinct values sorted in one task


def _wanted(probabilities: dict[str, float]) -> Column:
    """Whether the ranks from ``_before`` on, ``_size`` of them, hold a wanted one of ``n``."""
    out, end = F.lit(False), F.col("_before") + F.col("_size")
    for p in probabilities.values():
        rank = F.lit(p) * (F.col("n") - 1)
        out = out | ((F.col("_before") <= F.ceil(rank)) & (F.floor(rank) < end))
    return out


def _cut(rows: DataFrame, by: list[str], large: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """The wanted parts of the large parts of ``rows``, with their numbers and the ranks before them."""
    inside = rows.join(lookup(large), [*by, "_part"], "left_semi")
    marks = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    cuts = inside.groupBy(*by, "_part").agg(F.percentile_approx("_value", marks, ACCURACY).alias("_cuts"))
    keyed = inside.join(lookup(cuts), [*by, "_part"])
    # binary search for the number of cuts below the value, in plain comparisons
    keyed = keyed.withColumn("_nth", F.lit(0))
    for half in HALVES:
        above = F.col("_value") > F.get("_cuts", F.col("_nth") + (half - 1))
        keyed = keyed.withColumn("_nth", F.col("_nth") + F.when(above, half).otherwise(0))
    keyed = keyed.drop("_cuts")
    sizes = keyed.groupBy(*by, "_part", "_nth", "n", "_before").agg(F.sum("_count").alias("_size"))
    earlier = Window.partitionBy(*by, "_part").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    kept = sizes.where(_wanted(probabilities)).select(*by, "_part", "_nth", F.col("_before").alias("_from"))
    found = keyed.join(lookup(kept), [*by, "_part", "_nth"])
    number = F.col("_part") * (CUTS + 1) + F.col("_nth") + 1
    return found.select(*by, "_value", "_count", "n", number.alias("_part"), F.col("_from").alias("_before"))


def bounded_parts(
    counts: DataFrame, by: list[str], probabilities: dict[str, float], most: int = PART
) -> DataFrame:
    """Values (by, _value, _count, n, _part, _before) of parts of at most ``most`` distinct values that hold every wanted rank."""
    rows = counts
    while True:
        large = rows.groupBy(*by, "_part").count().where(F.col("count") > most).select(*by, "_part")
        large = materialize(large)
        if large.isEmpty():
            return rows
        small = rows.join(lookup(large), [*by, "_part"], "left_anti").select(rows.columns)
        rows = materialize(small.unionByName(_cut(rows, by, large, probabilities)))


def exact_percentiles(
    rows: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], most: int = PART
) -> DataFrame:
    """One row per key: ``n`` (non-null values) and one column per probability."""
    by = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    named = [F.col(k).alias(b) for k, b in zip(keys, by)] or [F.lit(0).alias("_k0")]
    counts = materialize(
        rows.where(F.col(value).isNotNull())
        .groupBy(*named, F.col(value).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_count"))
    )
    # a null key is a group like any other
    coded = counts.withColumns({b: F.struct(b) for b in by}) if keys else counts
    totals = coded.groupBy(*by).agg(F.sum("_count").alias("n"))
    start = {"_part": F.lit(0).cast("bigint"), "_before": F.lit(0).cast("bigint")}
    parts = bounded_parts(coded.join(lookup(totals), by).withColumns(start), by, probabilities, most)
    inside = Window.partitionBy(*by, "_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    cumulated = parts.withColumn("_upto", F.sum("_count").over(inside) + F.col("_before"))
    below = F.col("_upto") - F.col("_count")

    def at_rank(rank: Column) -> Column:
        hit = (below <= rank) & (rank < F.col("_upto"))
        return F.max(F.when(hit, F.col("_value")))

    picks, results = [], []
    for name, p in probabilities.items():
        rank = F.lit(p) * (F.col("n") - 1)
        picks += [
            at_rank(F.floor(rank)).alias(f"_lo_{name}"),
            at_rank(F.ceil(rank)).alias(f"_hi_{name}"),
        ]
        part = rank - F.floor(rank)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        results.append((lo + (hi - lo) * part).alias(name))
    picked = cumulated.groupBy(*by, "n").agg(*picks)
    return picked.select(*[F.col(b)[b].alias(k) for k, b in zip(keys, by)], "n", *results)
