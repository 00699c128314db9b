import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotline.functions import blocks, vectors
from shotline.operators import cascade, centroid, pruned, search
from shotline.sources.embeddings import embed_missing, embedding_status, load_embeddings

SCHEMA = "item_id bigint, species string, vec array<double>"


def table(spark, matrix, labels, first=0):
    rows = [(first + i, str(l), [float(x) for x in v]) for i, (v, l) in enumerate(zip(matrix, labels))]
    return spark.createDataFrame(rows, SCHEMA)


def distances(q, g, metric):
    norm = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) > 0, np.linalg.norm(m, axis=1, keepdims=True), 1)
    if metric in ("cosine", "euclidean_l2norm"):
        q, g = norm(q), norm(g)
    if metric == "cosine":
        out = 1 - (q[:, None, :] * g[None, :, :]).sum(2)
    elif metric == "manhattan":
        out = np.abs(q[:, None, :] - g[None, :, :]).sum(2)
    else:
        out = np.sqrt(((q[:, None, :] - g[None, :, :]) ** 2).sum(2))
    return np.round(out, 10)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    gallery = rng.normal(size=(60, 6))
    gallery[20:40] = gallery[3]  # a third of the gallery are copies
    queries = np.vstack([rng.normal(size=(38, 6)), gallery[3], np.zeros(6)])
    return queries, gallery, rng.integers(0, 4, 60), rng.integers(0, 5, 40)


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "euclidean_l2norm", "manhattan"])
@pytest.mark.parametrize("sizes", [{}, {"broadcast_rows": 0, "block_rows": 16}])
def test_nearest_equals_brute_force(spark, sample, metric, sizes):
    q, g, gl, ql = sample
    got = search.nearest(table(spark, q, ql), table(spark, g, gl, 1000), 7, metric, **sizes).collect()
    found = {(r["item_id"], r["rank"]): (r["neighbour_id"] - 1000, r["neighbour"], r["distance"]) for r in got}
    full = distances(q, g, metric)
    assert len(found) == len(q) * 7
    for i in range(len(q)):
        order = np.lexsort((np.arange(len(g)), full[i]))[:7]
        for rank, j in enumerate(order, 1):
            hit, label, d = found[(i, rank)]
            assert (hit, label) == (j, str(gl[j])) and d == pytest.approx(full[i, j], abs=1e-9)


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_pruned_search_skips_pairs_and_keeps_all_results(spark, monkeypatch, metric):
    """Far groups never meet; one group holds a third of the rows, zero vectors and copies; few blocks a task."""
    monkeypatch.setattr(pruned, "RUN", 2)
    monkeypatch.setattr(pruned, "PIECE", 20)
    rng = np.random.default_rng(11)
    middles = rng.normal(size=(12, 8)) * 10
    of = np.concatenate([np.zeros(300, int), rng.integers(0, 12, 600)])
    g = middles[of] + rng.normal(size=(900, 8)) * 0.05
    g[10:60], g[880:884] = g[5], 0.0
    q = middles[rng.integers(0, 12, 200)] + rng.normal(size=(200, 8)) * 0.05
    q[7], q[8] = g[5], 0.0
    found, report = pruned.search(table(spark, q, of[:200]), table(spark, g, of, 1000), 4, metric, 32)
    full = distances(q, g, metric)
    want = [(i, r, int(j) + 1000) for i in range(200) for r, j in enumerate(np.lexsort((np.arange(900), full[i]))[:4], 1)]
    assert sorted((r["item_id"], r["rank"], r["neighbour_id"]) for r in found.collect()) == want
    counts = report.first()
    assert counts["pairs"] == counts["query_blocks"] * counts["gallery_blocks"]
    assert counts["met"] < counts["pairs"] * 0.5


def test_pruned_search_of_few_and_no_rows(spark):
    one, none = table(spark, [[1.0, 0.0]], ["a"]), table(spark, [], [])
    assert [r["distance"] for r in pruned.nearest(one, one, 3, "cosine", 8).collect()] == [0.0]
    assert pruned.nearest(one, none, 3, "cosine", 8).count() == pruned.nearest(none, one, 3, "euclidean", 8).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"broadcast_rows": 0, "block_rows": 16}])
def test_label_minima_and_missing_class(spark, sample, sizes):
    q, g, gl, ql = sample
    got = {r["item_id"]: r for r in search.label_minima(table(spark, q, ql), table(spark, g, gl), **sizes).collect()}
    full = distances(q, g, "cosine")
    for i in range(len(q)):
        same = gl == ql[i]
        if same.any():
            assert got[i]["d_same"] == pytest.approx(full[i, same].min(), abs=1e-9)
        else:
            assert got[i]["d_same"] is None
        assert got[i]["d_other"] == pytest.approx(full[i, ~same].min(), abs=1e-9)


def test_more_neighbours_than_gallery_rows(spark, sample):
    q, g, gl, ql = sample
    got = search.nearest(table(spark, q[:3], ql[:3]), table(spark, g[:4], gl[:4]), 9)
    assert got.count() == 12


def test_subsets_agree_between_plans(spark, sample):
    q, g, gl, ql = sample
    flags = F.when(F.col("species").cast("int") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    qs, gs = table(spark, q, ql % 4).withColumn("subsets", flags), table(spark, g, gl).withColumn("subsets", flags)
    one = search.nearest_per_subset(qs, gs, 2).toPandas()
    two = search.nearest_per_subset(qs, gs, 2, broadcast_rows=0, block_rows=16).toPandas()
    key = ["item_id", "subset"]
    one, two = one.sort_values(key).reset_index(drop=True), two.sort_values(key).reset_index(drop=True)
    assert len(one) == len(two) and np.allclose(one["distance"], two["distance"])


def test_euclidean_of_unit_vectors_follows_from_cosine(spark, sample):
    q, g, gl, ql = sample
    pair = table(spark, q[:20], ql[:20]).select("item_id", F.col("vec").alias("a")).join(
        table(spark, g[:20], gl[:20]).select("item_id", F.col("vec").alias("b")), "item_id"
    )
    row = pair.select(
        F.max(
            F.abs(
                vectors.DISTANCES["euclidean_l2norm"](F.col("a"), F.col("b"))
                - F.sqrt(2 * vectors.DISTANCES["cosine"](F.col("a"), F.col("b")))
            )
        ).alias("gap")
    ).first()
    assert row["gap"] < 1e-9


def test_zero_vector_stays_zero(spark):
    rows = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in rows.select(vectors.unit(F.col("v"))).collect()] == [[0.0, 0.0], [0.6, 0.8]]


def test_merged_sums_equal_sums_of_everything(spark, sample):
    _, g, gl, _ = sample
    rows = table(spark, g, gl)
    whole = {r["species"]: r for r in centroid.class_sums(rows).collect()}
    merged = centroid.merge_sums(
        centroid.class_sums(rows.where("item_id < 25")), centroid.class_sums(rows.where("item_id >= 25"))
    )
    for r in merged.collect():
        assert r["n"] == whole[r["species"]]["n"] and np.allclose(r["total"], whole[r["species"]]["total"])


def test_votes_and_padding(spark):
    near = spark.createDataFrame(
        [(1, "x", 1, "b", 0.1), (1, "x", 2, "a", 0.2), (1, "x", 3, "a", 0.2), (1, "x", 4, "b", 0.9)],
        "item_id int, species string, rank int, neighbour string, distance double",
    )
    votes = {r["k"]: r["y_pred"] for r in cascade.majority_vote(near, [1, 3, 4]).collect()}
    assert votes == {1: "b", 3: "a", 4: "a"}
    assert cascade.weighted_vote(near).first()["y_pred"] == "b"
    assert cascade.ranked_labels(near, 4).first()["labels"] == ["b", "a", "a", "a"]


def test_cascade_zones_against_brute_force(spark, sample):
    q, g, gl, ql = sample
    queries, gallery = table(spark, q[:38], ql[:38]), table(spark, g, gl)
    cents = centroid.centroids(gallery, gallery_only=False)
    names = {r["species"]: np.array(r["vec"]) for r in cents.collect()}
    labels = sorted(names)
    matrix = np.vstack([names[s] for s in labels])
    d = np.round(1 - (q[:38] / np.linalg.norm(q[:38], axis=1, keepdims=True)) @ matrix.T, 10)
    near = distances(q[:38], g, "cosine")
    low, high = np.quantile(d.min(1), [0.3, 0.8])
    for r in cascade.three_zone(queries, cents, gallery, low, high).collect():
        i = r["item_id"]
        best = d[i].min()
        level = "alta" if best <= low else "rechazado" if best >= high else "baja"
        assert r["level"] == level and r["distance"] == pytest.approx(best, abs=1e-9)
        if level != "baja":
            assert r["y_pred"] == labels[d[i].argmin()]
            continue
        weight = {}
        for j in np.lexsort((np.arange(len(g)), near[i]))[:5]:
            weight[str(gl[j])] = weight.get(str(gl[j]), 0) + 1 / (near[i, j] + 1e-6)
        assert r["y_pred"] == max(weight, key=weight.get)
        assert any(t["species"] == r["y_pred"] for t in r["top5"])


def test_store_loading_and_missing_scoring(spark):
    items = spark.createDataFrame([(i, f"text {i}" if i != 5 else None) for i in range(8)], "item_id bigint, text string")
    store = spark.createDataFrame([(0, [1.0]), (1, None)], "item_id bigint, vec array<float>")
    loaded, missing = load_embeddings(items, store)
    assert loaded.count() == 1 and missing.count() == 7
    scored = embed_missing(items, store, "text", lambda s: np.array([[len(t), 1] for t in s]))
    counts = {r["status"]: r["n"] for r in embedding_status(items, store, scored).collect()}
    assert counts == {"skip": 2, "ok": 5, "error": 1}


@pytest.mark.parametrize("scale", [1.0, 100.0, 1e5])
@pytest.mark.parametrize("sizes", [{}, {"broadcast_rows": 0, "block_rows": 7}, {"broadcast_rows": 0, "block_rows": 33}])
def test_near_copies_find_themselves_in_every_plan(spark, scale, sizes):
    rng = np.random.default_rng(9)
    base = rng.normal(size=768)
    base *= scale / np.linalg.norm(base)
    matrix = np.stack([base + scale * 1e-7 * rng.normal(size=768) for _ in range(36)] + [base] * 4)
    labels = [f"s{i % 5}" for i in range(40)]
    rows = table(spark, matrix, labels)
    full = distances(matrix, matrix, "euclidean")
    best = {r["item_id"]: r for r in search.nearest(rows, rows, 1, "euclidean", **sizes).collect()}
    assert all(best[i]["neighbour_id"] == min(i, 36) and best[i]["distance"] == 0 for i in range(40))
    minima = {r["item_id"]: r for r in search.label_minima(rows, rows, "euclidean", **sizes).collect()}
    far = {r["item_id"]: r for r in search.farthest(rows, rows, "euclidean", **sizes).collect()}
    flagged = rows.withColumn("subsets", F.array(F.lit(0), F.lit(1)))
    subset = {(r["item_id"], r["subset"]): r for r in search.nearest_per_subset(flagged, flagged, 2, **sizes).collect()}
    names = np.array(labels)
    for i in range(40):
        other = full[i][names != labels[i]].min()
        assert minima[i]["d_same"] == 0 and minima[i]["d_other"] == pytest.approx(other, abs=2e-10)
        assert far[i]["distance"] == pytest.approx(full[i].max(), abs=2e-10)
        assert far[i]["neighbour"] == max(names[full[i] >= full[i].max()])
        for s in (0, 1):
            assert subset[i, s]["distance"] == 0
            assert subset[i, s]["neighbour"] == (min(names[36:]) if i >= 36 else labels[i])


def test_a_gallery_is_collected_once(spark, sample):
    q, g, gl, ql = sample
    queries, gallery = table(spark, q, ql), table(spark, g, gl, 1000)
    kept = search.Gallery(gallery)
    assert kept.shared is not None and kept.count == 60
    want = sorted(map(tuple, search.nearest(queries, gallery, 3).collect()))
    assert sorted(map(tuple, search.nearest(queries, kept, 3).collect())) == want


@pytest.mark.parametrize("rows", [1, 7, 10_000])
def test_embeddings_do_not_depend_on_the_batch_size(spark, rows):
    from shotline.plans.catalog_queries import letter_frequencies

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    texts = [None, "", "Abc ab\na", "İstanbul ß", *[chr(97 + i % 26) * (i + 1) for i in range(30)]]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id int, text string")
    try:
        spark.conf.set(key, str(rows))
        got = {r["item_id"]: r for r in embed_missing(items, items.where("item_id = 5").select("item_id"), "text", letter_frequencies).collect()}
    finally:
        spark.conf.set(key, before)
    assert sorted(got) == [i for i in range(len(texts)) if i != 5] and got[0]["status"] == "error"
    for i, text in enumerate(texts):
        if text is not None and i != 5:
            letters = [c for c in text.lower() if "a" <= c <= "z"]
            want = [letters.count(chr(97 + j)) / max(len(letters), 1) for j in range(26)]
            assert got[i]["vec"] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_distances_in_memory_stay_below_cells(monkeypatch, metric):
    """Fewer query rows meet a larger block; what is found does not depend on it."""
    from shotline.functions import blocks

    rng = np.random.default_rng(3)
    side = lambda n: blocks.Block(np.arange(n), rng.choice(list("abc"), n).astype(object), np.round(rng.normal(size=(n, 4)), 1))
    q, g = side(90), side(70)
    q.scale, g.scale = np.ones(90), np.ones(70)
    screen, shapes = blocks.screen, []

    def seen(a, b, m):
        shapes.append(len(a) * len(b))
        return screen(a, b, m)

    def found():
        near = [np.concatenate(c) for c in zip(*blocks.top_k(q, g, 5, metric))]
        least = [np.concatenate(c) for c in zip(*(f[1:] for f in blocks.same_and_other(q, g, metric)))]
        far = [np.concatenate(c) for c in zip(*blocks.farthest(q, g, metric))]
        return [*near, *least, *far, blocks.worst_ratio(q, g)]

    monkeypatch.setattr(blocks, "screen", seen)
    whole = found()
    shapes.clear()
    monkeypatch.setattr(blocks, "CELLS", 700)
    cut = found()
    assert max(shapes) <= 700
    for a, b in zip(whole, cut):
        np.testing.assert_allclose(a, b, rtol=1e-12)


def test_letters_are_counted_in_bounded_runs(monkeypatch):
    import tracemalloc

    from shotline.plans import catalog_queries

    texts = ["", "aAb", "Ünï 7", "zz" * 40, "É" * 9, "abc" * 5]
    whole = catalog_queries.letter_frequencies(texts)
    assert whole[1].tolist()[:2] == pytest.approx([2 / 3, 1 / 3]) and whole[0].sum() == 0 and whole[3][25] == 1
    large = ["abcdefgh" * 125_000] * 20
    tracemalloc.start()
    got = catalog_queries.letter_frequencies(large)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[:, :8] == pytest.approx(1 / 8) and peak < 120e6
    monkeypatch.setattr(catalog_queries, "LETTERS", 7)
    np.testing.assert_array_equal(whole, catalog_queries.letter_frequencies(texts))


def test_manhattan_screen_needs_little_beside_its_result():
    rng = np.random.default_rng(5)
    q, g = rng.normal(size=(300, 16)), rng.normal(size=(2000, 16))
    tracemalloc.start()
    found, error = blocks.screen(q, g, "manhattan")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    naive = np.abs(q[:, None, :] - g[None, :, :]).sum(2)
    assert (np.abs(found - naive) <= error[:, None]).all()
    assert peak < 2 * found.nbytes  # differences of all pairs at once would be as large as the result, twice


def peak(run):
    tracemalloc.start()
    run()
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return used


def random_block(rng, n, dims=64):
    return blocks.Block(np.arange(n), np.array([f"sp{i % 10}" for i in range(n)], object), rng.normal(size=(n, dims)))


def test_memory_of_a_comparison_is_bounded():
    rng = np.random.default_rng(2)
    q, g = random_block(rng, 600), random_block(rng, 16_384)
    prepared = blocks.prepared(g.matrix, "cosine", True).nbytes  # one copy of the gallery block
    assert peak(lambda: list(blocks.same_and_other(q, g, "cosine"))) < prepared * 2 + (16 << 20)
    assert peak(lambda: list(blocks.top_k(q, g, 5, "cosine"))) < prepared * 2 + (16 << 20)
    some = rng.integers(0, 600, 150_000)
    assert peak(lambda: blocks.paired(q.matrix, g.matrix, some, some, "cosine")) < 48 << 20


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_rows_beyond_what_was_seen_are_left_out_and_none_within(monkeypatch, metric):
    rng = np.random.default_rng(9)
    q, g = random_block(rng, 40, 6), random_block(rng, 500, 6)
    g.matrix[300:340] = g.matrix[7]  # ties with rows seen before
    full = distances(q.matrix, g.matrix, metric)
    reach = np.sort(full[:, :250], 1)[:, 3]
    late = blocks.Block(g.ids[250:], g.labels[250:], g.matrix[250:])
    found = list(blocks.top_k(q, late, 4, metric, reach))
    got = {(int(i), int(j)) for f in found for i, j in zip(f[0], f[1])}
    want = {(i, int(j)) for i in range(40) for j in np.lexsort((np.arange(250), full[i, 250:]))[:4] if full[i, 250 + j] <= reach[i]}
    assert want <= got and len(got) < 40 * 4


def test_labels_compare_by_value_and_null_only_to_null():
    rng = np.random.default_rng(3)
    q, g = random_block(rng, 6), random_block(rng, 9)
    q.labels[:] = ["a", None, "b", "x", None, "a"]
    g.labels[:] = ["a", "a", None, "b", "b", None, "c", "c", "c"]
    full = distances(q.matrix, g.matrix, "cosine")
    (_, same, other), = blocks.same_and_other(q, g, "cosine")
    for i in range(6):
        own = np.array([x == q.labels[i] for x in g.labels])
        assert np.isnan(same[i]) if not own.any() else same[i] == pytest.approx(full[i, own].min(), abs=1e-9)
        assert other[i] == pytest.approx(full[i, ~own].min(), abs=1e-9)
