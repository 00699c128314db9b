import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shotline.functions import blocks, finder
from shotline.operators import pruned, search
from shotline.plans import QUERIES

METRICS = ("cosine", "euclidean", "euclidean_l2norm", "manhattan")
SCHEMA = "item_id bigint, species string, vec array<double>"


def block(matrix, first=0):
    ids = np.arange(first, first + len(matrix))
    return blocks.Block(ids, np.array([f"s{i % 7}" for i in ids], object), matrix)


def table(spark, matrix, first=0):
    side = block(matrix, first)
    return spark.createDataFrame([(int(i), l, [float(x) for x in v]) for i, l, v in zip(side.ids, side.labels, matrix)], SCHEMA)


def distances(q, g, metric):
    if metric in ("cosine", "euclidean_l2norm"):
        q, g = blocks.normalised(q), blocks.normalised(g)
    if metric == "cosine":
        out = 1.0 - (q[:, None, :] * g[None, :, :]).sum(2)
    elif metric == "manhattan":
        out = np.abs(q[:, None, :] - g[None, :, :]).sum(2)
    else:
        out = np.sqrt(((q[:, None, :] - g[None, :, :]) ** 2).sum(2))
    return np.round(out, 10)


def wanted(q, g, k, metric):
    full = distances(q, g, metric)
    return [(i, r, int(j)) for i in range(len(q)) for r, j in enumerate(np.lexsort((np.arange(len(g)), full[i]))[:k], 1)]


def shapes():
    rng = np.random.default_rng(23)
    normal = lambda n, d: rng.normal(size=(n, d))
    yield "plain", normal(70, 64), normal(900, 64)
    yield "shifted and stretched", normal(40, 64) * np.arange(1, 65) + 1e3, normal(600, 64) * np.arange(1, 65) + 1e3
    q, g = normal(60, 8), normal(700, 8)
    g[100:350], q[5:30], g[400:420], q[3] = g[3], g[3], 0.0, 0.0
    yield "copies and zero vectors", q, g
    q, g = normal(60, 16), normal(800, 16)
    g[200:600], q[:30] = g[0] + normal(400, 16) * 1e-7, g[0] + normal(30, 16) * 1e-7
    yield "near copies", q, g
    q, g = normal(50, 5), normal(700, 5)
    g[7], g[9], q[0] = g[7] * 1e9, g[9] * 1e-9, q[0] * 1e8
    yield "far outliers", q, g
    yield "large numbers", normal(30, 6) * 1e25, normal(300, 6) * 1e25
    yield "small numbers", normal(30, 6) * 1e-3, normal(300, 6) * 1e-3
    q, g = blocks.normalised(normal(50, 12)), blocks.normalised(normal(600, 12))
    g[50:90], q[4] = g[1] + normal(40, 12) * 1e-5, g[1]
    yield "unit vectors", q * 1.0001, g * rng.uniform(0.9998, 1.0002, 600)[:, None]
    yield "many components", normal(9, 600), normal(200, 600)
    yield "all equal", np.ones((4, 3)), np.ones((9, 3))
    yield "one row", normal(1, 4), normal(1, 4)


@pytest.mark.parametrize("k", [1, 4])
@pytest.mark.parametrize("name, q, g", list(shapes()), ids=lambda x: x if isinstance(x, str) else "")
def test_finder_equals_brute_force_in_any_order(monkeypatch, name, q, g, k):
    monkeypatch.setattr(finder, "COLUMNS", 256)
    monkeypatch.setattr(finder, "ROWS", 16)
    monkeypatch.setattr(finder, "BYTE_ROWS", 8)
    monkeypatch.setattr(finder, "CROWD", 8)
    monkeypatch.setattr(finder, "WAITING", 500)
    of = finder.Finder(block(q), k, METRICS)
    order, gallery = np.random.default_rng(1).permutation(len(g)), block(g)
    for start in range(0, len(g), 300):
        part = order[start : start + 300]
        of.offer(blocks.Block(gallery.ids[part], gallery.labels[part], g[part]))
    for metric in METRICS:
        rows, ids, labels, dist, rank = of.found(metric)
        full = distances(q, g, metric)
        np.testing.assert_allclose(dist, full[rows, ids], rtol=1e-9, atol=2e-10)
        assert all(labels == gallery.labels[ids])
        if name != "large numbers":  # there the order of additions moves the tenth decimal
            assert [*zip(rows.tolist(), rank.tolist(), ids.tolist())] == wanted(q, g, k, metric)
        else:
            np.testing.assert_allclose(dist, np.sort(full, 1)[:, :k].ravel(), rtol=1e-9)


def test_rows_that_are_no_numbers_hide_no_others():
    rng = np.random.default_rng(4)
    q, g = rng.normal(size=(8, 6)), rng.normal(size=(50, 6))
    g[10, 2], g[11, 0], q[3, 1] = np.nan, np.inf, np.nan
    of = finder.Finder(block(q), 2, METRICS)
    of.offer(block(g))
    whole, asked = np.delete(np.arange(50), [10, 11]), np.delete(np.arange(8), 3)
    for metric in METRICS:
        rows, ids, *_ = of.found(metric)
        assert [*zip(rows, ids)] == [(asked[i], whole[j]) for i, _, j in wanted(q[asked], g[whole], 2, metric)]


def test_screens_leave_few_pairs(monkeypatch):
    """Before, each metric screened all pairs in double precision by itself."""
    rng = np.random.default_rng(6)
    measured, again, paired, screen = [], [], blocks.paired, blocks.screen
    monkeypatch.setattr(blocks, "paired", lambda q, g, rows, cols, m: measured.append(len(rows)) or paired(q, g, rows, cols, m))
    monkeypatch.setattr(blocks, "screen", lambda q, g, m: again.append(len(q) * len(g)) or screen(q, g, m))
    of = finder.Finder(block(rng.normal(size=(300, 64)) / 8), 1, METRICS)
    for start in range(0, 12_000, 2_000):
        of.offer(block(rng.normal(size=(2_000, 64)) / 8, start))
    pairs = 300 * 12_000 * 4
    assert sum(measured) < pairs * 0.01 and sum(again) < pairs * 0.05


def test_a_common_vector_is_measured_once_a_piece(monkeypatch):
    rng = np.random.default_rng(7)
    q, g = rng.normal(size=(200, 16)), rng.normal(size=(3_000, 16))
    g[500:2_500], q[50:150] = g[5], g[5]  # 200,000 pairs of equal vectors
    measured, paired = [], blocks.paired
    monkeypatch.setattr(blocks, "paired", lambda q, g, rows, cols, m: measured.append(len(rows)) or paired(q, g, rows, cols, m))
    of = finder.Finder(block(q), 2, METRICS)
    of.offer(block(g))
    for metric in METRICS:
        rows, ids, *_ = of.found(metric)
        assert all(ids[np.isin(rows, np.arange(50, 150))] == np.tile([5, 500], 100))
    assert sum(measured) < 4 * 200 * 3_000 * 0.02


@pytest.mark.parametrize("text", [False, True])
@pytest.mark.parametrize("sizes", [{}, {"broadcast_rows": 0, "block_rows": 16}])
def test_several_metrics_in_one_pass(spark, sizes, text):
    rng = np.random.default_rng(8)
    q, g = rng.normal(size=(45, 6)), rng.normal(size=(70, 6))
    g[20:40], q[2] = g[3], g[3]
    sides = [table(spark, q), table(spark, g, 1000)]
    if text:
        sides = [s.withColumn("item_id", F.concat(F.lit("i"), "item_id")) for s in sides]
    got = search.nearest(*sides, 3, METRICS, **sizes)
    assert got.columns == ["item_id", "species", "neighbour_id", "neighbour", "distance", "rank", "metric"]
    rows = got.collect()
    number = lambda x: int(str(x).lstrip("i"))
    for metric in METRICS:
        mine = [r for r in rows if r["metric"] == metric]
        assert sorted((number(r["item_id"]), r["rank"], number(r["neighbour_id"]) - 1000) for r in mine) == wanted(q, g, 3, metric)
        assert all(r["neighbour"] == f"s{number(r['neighbour_id']) % 7}" and r["species"] == f"s{number(r['item_id']) % 7}" for r in mine)
    with pytest.raises(ValueError):
        search.nearest(*sides, 3, ("cosine", "other"))
    none = sides[1].where("false")
    assert search.nearest(sides[0], none, 1, METRICS, **sizes).count() == search.nearest(none, sides[1], 1, METRICS, **sizes).count() == 0


def test_distance_grid_meets_the_gallery_once_a_model(spark, monkeypatch, tmp_path):
    """Beyond a broadcast, each of the eight pairs of model and metric cut, stored and searched both sides by itself."""
    rng = np.random.default_rng(12)
    label = rng.integers(0, 5, 300)
    vectors = (rng.normal(size=(300, 12)) + rng.normal(size=(5, 12))[label]).astype(np.float32)
    rows = {"vec_id": pa.array(range(300)), "embedding": pa.array(list(vectors)), "label": pa.array(label.astype(np.int32))}
    pq.write_table(pa.table(rows), tmp_path / "embeddings.parquet")
    small = sorted(map(tuple, QUERIES["b8_distance_grid"](spark, str(tmp_path)).collect()))
    assert len(small) == 8 and all(r[2] > 0.2 for r in small)

    searches, nearest = [], search.nearest
    monkeypatch.setattr(search, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(pruned, "search", lambda *_: pytest.fail("searched for one metric"))
    monkeypatch.setattr(search, "nearest", lambda *a, **b: searches.append(b["metric"]) or nearest(*a, **b))
    large = sorted(map(tuple, QUERIES["b8_distance_grid"](spark, str(tmp_path)).collect()))
    assert large == small and [set(m) for m in searches] == [set(METRICS)] * 2


def test_distance_grid_of_no_items(spark, tmp_path):
    kinds = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])
    pq.write_table(kinds.empty_table(), tmp_path / "embeddings.parquet")
    found = QUERIES["b8_distance_grid"](spark, str(tmp_path)).collect()
    assert len(found) == 8 and all(r["accuracy"] is None for r in found)
