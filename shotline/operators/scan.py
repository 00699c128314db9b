"""Running aggregates over ordered rows, without one task per key.

A window over a key puts all rows of that key into one task. Here every key is
cut into chunks that follow the sort order; windows run inside a chunk, the
chunk totals (one row per chunk) are accumulated by a second, small window, and
both are added. A key that holds a third of the data is then as parallel as it
has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotline.session import lookup, materialize

CHUNK = "_chunk"


def running(
    rows: DataFrame,
    keys: list[str],
    order: list[Column | str],
    chunk: Column,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
) -> DataFrame:
    """Add inclusive running sums and maxima and the previous row's value.

    ``chunk`` must not decrease along ``order``. Keys must not be null.
    """
    sums, maxes, previous = sums or {}, maxes or {}, previous or {}
    rows = rows.withColumn(CHUNK, chunk)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select(
        "*",
        *[F.sum(c).over(upto).alias(f"_s_{n}") for n, c in sums.items()],
        *[F.max(c).over(upto).alias(f"_m_{n}") for n, c in maxes.items()],
        *[F.lag(F.struct(c.alias("v"))).over(inside).alias(f"_p_{n}") for n, c in previous.items()],
        *([F.row_number().over(inside).alias("_row")] if previous else []),
        *[F.struct(c.alias("v")).alias(f"_v_{n}") for n, c in previous.items()],
    )
    # sums may fall when negative values occur, so totals come from the values
    totals = local.groupBy(*keys, CHUNK).agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()],
        *[F.max(F.col(f"_m_{n}")).alias(f"_x_{n}") for n in maxes],
        *[F.max_by(f"_v_{n}", "_row").alias(f"_l_{n}") for n in previous],
    )
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        CHUNK,
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_t_{n}") for n in sums],
        *[F.max(f"_x_{n}").over(before).alias(f"_x_{n}") for n in maxes],
        *[F.lag(f"_l_{n}").over(by_chunk).alias(f"_l_{n}") for n in previous],
    )
    joined = local.join(carry, [*keys, CHUNK])
    return joined.select(
        *rows.columns,
        *[(F.coalesce(F.col(f"_s_{n}"), F.lit(0)) + F.col(f"_t_{n}")).alias(n) for n in sums],
        *[F.greatest(f"_m_{n}", f"_x_{n}").alias(n) for n in maxes],
        *[F.coalesce(f"_p_{n}", f"_l_{n}").getField("v").alias(n) for n in previous],
    ).drop(CHUNK)


CUT = 255  # cut points of a key
LARGE = 16_384  # rows from which a key is cut


def sampled_chunks(rows: DataFrame, keys: list[str], order: str, large: int = LARGE) -> tuple[DataFrame, Column]:
    """The rows and a chunk for ``running``: keys of more than ``large`` rows are cut at sketched quantiles of ``order``.

    The chunks follow the data, whatever the unit or the density of ``order``. Equal
    values share a chunk; nulls come first.
    """
    rows = materialize(rows)
    many = materialize(rows.groupBy(*keys).count().where(F.col("count") > large).select(*keys))
    if many.isEmpty():
        return rows, F.lit(0)
    marks = [i / (CUT + 1) for i in range(1, CUT + 1)]
    hot = rows.join(lookup(many), keys, "left_semi")
    cuts = hot.groupBy(*keys).agg(F.percentile_approx(order, marks, 16 * (CUT + 1)).alias("_cuts"))
    # binary search in plain comparisons; a key without cuts is one chunk
    found = rows.join(lookup(cuts), keys, "left").withColumn("_nth", F.lit(0))
    half = (CUT + 1) // 2
    while half:
        above = F.col(order) > F.get("_cuts", F.col("_nth") + (half - 1))
        found = found.withColumn("_nth", F.col("_nth") + F.when(above, half).otherwise(0))
        half //= 2
    return found.drop("_cuts"), F.col("_nth")


def across(
    rows: DataFrame,
    order: list[Column],
    sums: dict[str, Column] | None = None,
    maxes_before: dict[str, Column] | None = None,
) -> DataFrame:
    """Inclusive running sums, and maxima of the rows before, over the whole table in ``order``.

    The rows are dealt into ranges of the order and stored; windows run inside a range, and what the
    ranges before add up to (a few numbers per range) is joined on. Equal rows of the order share a
    range, so the order should be unique.
    """
    sums, maxes = sums or {}, maxes_before or {}
    spark = rows.sparkSession
    cut = materialize(rows.repartitionByRange(*order).withColumn(CHUNK, F.spark_partition_id()))
    inside = Window.partitionBy(CHUNK).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select(
        "*",
        *[F.sum(c).over(upto).alias(f"_s_{n}") for n, c in sums.items()],
        *[F.max(c).over(before).alias(f"_m_{n}") for n, c in maxes.items()],
    )
    totals = cut.groupBy(CHUNK).agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()], *[F.max(c).alias(f"_x_{n}") for n, c in maxes.items()]
    )
    carry, so_far = [], {n: None for n in totals.columns[1:]}
    for r in sorted(totals.collect(), key=lambda r: r[CHUNK]):  # one row per range
        carry.append((r[CHUNK], *so_far.values()))
        for n, held in so_far.items():
            if r[n] is not None:
                so_far[n] = r[n] if held is None else held + r[n] if n.startswith("_t_") else max(held, r[n])
    offsets = F.broadcast(spark.createDataFrame(carry, totals.schema))
    joined = local.join(offsets, CHUNK)
    return joined.select(
        *rows.columns,
        *[(F.coalesce(f"_s_{n}", F.lit(0)) + F.coalesce(f"_t_{n}", F.lit(0))).alias(n) for n in sums],
        *[F.greatest(f"_m_{n}", f"_x_{n}").alias(n) for n in maxes],
    )


def digest(seed: int, *ids: Column) -> Column:
    """Reproducible pseudo-random text, the same in any SQL engine with md5."""
    return F.md5(F.concat_ws("~", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def shuffled_rank(
    rows: DataFrame, keys: list[str], item: str, seed: int, name: str = "rank", digits: int = 3
) -> DataFrame:
    """Rank rows 1..n inside each key in seeded order.

    Chunks are digest prefixes, hence even: 16 ** ``digits`` of them per key.
    """
    rows = rows.withColumn("_digest", digest(seed, F.col(item)))
    ranked = running(
        rows,
        keys,
        ["_digest", item],
        F.substring("_digest", 1, digits),
        sums={name: F.lit(1)},
    )
    return ranked.drop("_digest")


def numbered(rows: DataFrame, keys: list[str], order: str, span: int, name: str) -> DataFrame:
    """Number rows 1..n inside each key by a unique integer column ``order``."""
    return running(
        rows, keys, [order], F.floor(F.col(order) / F.lit(span)), sums={name: F.lit(1)}
    )
