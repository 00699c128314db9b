import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shotline.operators import scan
from shotline.operators.percentiles import bounded_parts, exact_percentiles


def hot_rows(seed=0):
    """One key holds most rows."""
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(900) < 0.7, 0, rng.integers(1, 9, 900))
    rows = pd.DataFrame({"key": keys, "pos": rng.permutation(900), "v": rng.integers(-5, 9, 900)})
    return rows.astype({"key": "int64", "pos": "int64", "v": "int64"})


@pytest.mark.parametrize("span", [7, 100, 10_000])
def test_running_matches_a_plain_cumulation(spark, span):
    rows = hot_rows()
    out = scan.running(
        spark.createDataFrame(rows),
        ["key"],
        ["pos"],
        F.floor(F.col("pos") / span),
        sums={"total": F.col("v"), "rn": F.lit(1)},
        maxes={"top": F.col("v")},
        previous={"prev": F.col("v")},
    ).toPandas()
    rows = rows.sort_values(["key", "pos"])
    by = rows.groupby("key")["v"]
    want = rows.assign(total=by.cumsum(), rn=by.cumcount() + 1, top=by.cummax(), prev=by.shift())
    got = out.sort_values(["key", "pos"])[list(want.columns)]
    pd.testing.assert_frame_equal(
        got.reset_index(drop=True), want.reset_index(drop=True), check_dtype=False
    )


def test_running_keeps_null_previous_values(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, 5), (1, 2, None), (1, 3, 7)], "key int, pos int, v int")
    out = scan.running(rows, ["key"], ["pos"], F.floor(F.col("pos") / 2), previous={"p": F.col("v")})
    assert [r["p"] for r in out.orderBy("pos").collect()] == [None, None, 5, None]


def test_shuffled_rank_is_a_permutation_of_each_key(spark):
    rows = spark.createDataFrame(hot_rows())
    out = scan.shuffled_rank(rows, ["key"], "pos", 29).toPandas()
    for _, group in out.groupby("key"):
        assert sorted(group["rank"]) == list(range(1, len(group) + 1))


PROBS = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p97": 0.97, "p100": 1.0}


@pytest.mark.parametrize(
    "values",
    [
        [3.5],
        [1.0, 2.0],
        list(np.random.default_rng(1).normal(size=777)),
        [4.0] * 300 + list(np.random.default_rng(2).normal(size=600)),
        [1.0] * 500,
        [1e12] + list(np.random.default_rng(3).random(200)),
    ],
)
def test_percentiles_equal_linear_interpolation(spark, values):
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    row = exact_percentiles(rows, [], "v", PROBS).first()
    assert row["n"] == len(values)
    for name, p in PROBS.items():
        assert row[name] == pytest.approx(np.percentile(values, p * 100), rel=1e-12, abs=1e-12)


def test_percentiles_per_hot_key(spark):
    rows = hot_rows().astype({"v": "float64"})
    out = exact_percentiles(spark.createDataFrame(rows), ["key"], "v", PROBS).toPandas().set_index("key")
    for key, group in rows.groupby("key"):
        for name, p in PROBS.items():
            assert out.loc[key, name] == pytest.approx(np.percentile(group["v"], p * 100))


@pytest.mark.parametrize("most", [10, 300])
def test_one_group_of_all_rows_is_cut_until_parts_are_bounded(spark, most):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(0, 1, 20_000), np.repeat(7.0, 500), rng.integers(0, 50, 3_000)])
    rows = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(5)
    row = exact_percentiles(rows, [], "v", PROBS, most).first()
    assert row["n"] == len(values)
    for name, p in PROBS.items():
        assert row[name] == pytest.approx(np.percentile(values, p * 100), rel=1e-12)
    counts = rows.groupBy(F.lit(0).alias("_k0"), F.col("v").alias("_value")).agg(F.count(F.lit(1)).alias("_count"))
    zero = F.lit(0).cast("bigint")
    counts = counts.withColumns({"n": F.lit(len(values)), "_part": zero, "_before": zero})
    sizes = bounded_parts(counts, ["_k0"], PROBS, most).groupBy("_part").count().toPandas()["count"]
    assert sizes.max() <= most and sizes.sum() < 20_000


def test_percentiles_of_null_keys_and_no_rows(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", None)], "k string, v double")
    got = {r["k"]: (r["n"], r["m"]) for r in exact_percentiles(rows, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {None: (2, 2.0), "a": (1, 5.0)}
    assert exact_percentiles(rows.where("false"), ["k"], "v", {"m": 0.5}).count() == 0


def test_across_equals_a_plain_cumulation_without_a_single_task(spark):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"pos": rng.permutation(700), "v": rng.normal(0, 1, 700)})
    out = scan.across(spark.createDataFrame(frame).repartition(6), [F.desc("pos")], {"rank": F.lit(1), "total": F.col("v")}, {"top": F.col("v")})
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    got = out.toPandas().sort_values("pos", ascending=False)
    want = frame.sort_values("pos", ascending=False)
    assert got["rank"].tolist() == list(range(1, 701))
    assert got["total"].to_numpy() == pytest.approx(want["v"].cumsum().to_numpy())
    assert got["top"].to_numpy()[1:] == pytest.approx(want["v"].cummax().shift().to_numpy()[1:])
    assert got["top"].isna().sum() == 1
    assert scan.across(spark.createDataFrame(frame).where("false"), [F.col("pos")], {"rank": F.lit(1)}).count() == 0


def test_one_key_is_cut_where_its_rows_are(spark):
    """Nearly all rows of one key lie in a short stretch of the order; ties stay together and nulls come first."""
    rng = np.random.default_rng(3)
    pos = np.concatenate([rng.normal(0, 1e-3, 20_000), [1e9, -1e9], np.repeat(0.5, 50)])
    frame = pd.DataFrame({"key": 1, "pos": pos, "v": 1})
    rows = spark.createDataFrame(frame).unionByName(spark.createDataFrame([(2, None, 1), (1, None, 1)], "key bigint, pos double, v bigint"))
    cut, chunk = scan.sampled_chunks(rows, ["key"], "pos", large=1_000)
    sizes = cut.withColumn("chunk", chunk).where("key = 1").groupBy("chunk").count().toPandas()["count"]
    assert len(sizes) > 200 and sizes.max() < 400
    out = scan.running(cut, ["key"], ["pos"], chunk, sums={"upto": F.col("v")}).where("key = 1").toPandas()
    want = np.searchsorted(np.sort(pos), out["pos"].dropna().to_numpy(), side="right") + 1
    got = out.dropna()["upto"].to_numpy()
    assert (got <= want).all() and sorted(out["upto"]) == list(range(1, len(pos) + 2))
    whole, one = scan.sampled_chunks(rows, ["key"], "pos")
    assert whole.withColumn("chunk", one).where("key = 2").first()["chunk"] == 0
