import pytest
from pyspark.sql import functions as F

from shotline.functions import labels
from shotline.operators import catalog, history, leaderboard, review
from shotline.sources import tables


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_csv_round_trip_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "index.csv"
    names = ",".join(tables.INDEX_SCHEMA.fieldNames())
    path.write_bytes(("﻿" + names + "\nx.jpg,Puma concolor,Puma,Felidae,gallery,3,Medio\n").encode())
    df = tables.read_csv(spark, str(path), tables.INDEX_SCHEMA)
    assert df.first().asDict()["species"] == "Puma concolor" and df.first()["filepath"] == "x.jpg"
    tables.write_csv(df, str(tmp_path / "out"))
    assert tables.read_csv(spark, str(tmp_path / "out"), tables.INDEX_SCHEMA).collect() == df.collect()


def test_images_are_listed_and_decomposed(spark, tmp_path):
    for name in ("images/Felidae/Puma/concolor/a.JPG", "images/Felidae/short.png", "images/F/G/s/b.txt"):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"1")
    found = catalog.image_paths(tables.read_images(spark, str(tmp_path))).collect()
    assert [(r["family"], r["genus"], r["folder"]) for r in found] == [("Felidae", "Puma", "concolor")]


def test_partitioned_arrays_and_markdown(spark, tmp_path):
    rows = spark.createDataFrame([("m", "cosine", 1, 0.5), ("m", "manhattan", 1, None)], "model string, metric string, item int, d double")
    tables.write_long_arrays(rows, str(tmp_path / "arrays"))
    back = spark.read.parquet(str(tmp_path / "arrays")).where("metric = 'cosine'")
    assert back.count() == 1 and (tmp_path / "arrays" / "model=m" / "metric=cosine").exists()
    tables.write_predictions(rows.select("model", F.col("metric").alias("classifier"), "item"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    tables.write_markdown(rows.select("item", "d"), str(tmp_path / "md"))
    lines = [line for part in sorted((tmp_path / "md").glob("part-*")) for line in part.read_text().splitlines()]
    assert lines[:2] == ["| item | d |", "|---|---|"] and sorted(lines[2:]) == ["| 1 |  |", "| 1 | 0.5 |"]


def test_threshold_documents_round_trip(spark):
    rows = spark.createDataFrame(
        [("m", "p90", 0.1, 0.9, 0.5, -0.1), ("m", "p95", 0.2, 0.95, 0.6, -0.2)],
        "model string, percentile string, threshold double, coverage double, inter_contamination double, separation_gap double",
    )
    documents = tables.threshold_documents(rows, ["model"])
    assert documents.count() == 1
    assert sorted(map(tuple, tables.read_threshold_documents(documents, ["model"]).collect())) == sorted(map(tuple, rows.collect()))


def test_times_and_texts(spark):
    row = one(
        spark,
        labels.clock(F.lit(125.9)).alias("a"),
        labels.clock(F.lit(-3.0)).alias("b"),
        labels.long_clock(F.lit(3725.0)).alias("c"),
        labels.interval(F.lit(None).cast("double"), F.lit(3.0)).alias("d"),
        labels.slug(F.lit("KNN (k=1)")).alias("e"),
        labels.speed_factor(F.lit(3.0), F.lit(0.0)).alias("f"),
        labels.motion_mode(F.lit(None).cast("string"), F.lit(True)).alias("g"),
        labels.second_candidate(F.lit("onca"), F.lit("panthera")).alias("h"),
        labels.second_candidate(F.lit("panthera onca"), F.lit("panthera")).alias("i"),
        labels.common_name(F.lit("NaN"), F.lit("puma"), F.lit("s")).alias("j"),
        labels.clip_name(F.lit("v"), F.lit(1.9), F.lit(7.2)).alias("k"),
    )
    assert tuple(row) == ("2:05", "0:00", "1:02:05", "—", "knn_k1", None, "Alto contraste", "panthera onca", "panthera onca", "puma", "v_1s-7s.mp4")


def test_score_lookup_precedence(spark):
    scores = spark.createDataFrame([("aa bb", 3), ("cc", 4), ("g1 dd", 5), ("tt", 2)], "species string, score int")
    aliases = catalog.map_rows(spark, {"al": "tt", "g1 xx": "tt", "gone": "nowhere"}, ("name", "target"))
    fixed = catalog.hardcoded_rows(spark, {"cc": (0, "Doméstica"), "g1 al": (9, "Crítico")})
    items = spark.createDataFrame(
        [(1, "g1", "AA_bb"), (2, "g1", "cc"), (3, "g1", "dd"), (4, "g1", "al"), (5, "g1", "xx"), (6, "g1", "gone")],
        "item_id int, genus string, folder string",
    )
    got = {r["item_id"]: (r["species"], r["score"], r["category"]) for r in catalog.with_scores(items, catalog.name_lookup(scores, aliases, fixed)).collect()}
    assert got == {
        1: ("AA bb", 3, "Medio"),
        2: ("cc", 0, "Doméstica"),
        3: ("g1 dd", 5, "Crítico"),
        4: ("al", 2, "Bajo"),
        5: ("xx", 2, "Bajo"),
        6: ("gone", 0, "Exótica/Invasora/Desconocida"),
    }
    assert [r["name"] for r in catalog.missing_targets(aliases, scores).collect()] == ["gone"]


def test_names_are_added_once(spark):
    index = spark.createDataFrame([("a",)], "species string")
    names = spark.createDataFrame([("a", "x")], "species string, nombre_comun_es_ar string")
    twice = catalog.with_common_names(catalog.with_common_names(index, names), names)
    assert twice.columns == ["species", "nombre_comun_es_ar"] and twice.first()["nombre_comun_es_ar"] == "x"


def test_latest_edit_wins_and_deletion_removes(spark):
    edits = spark.createDataFrame([(1, 1, "validate", "x"), (1, 2, "edit", "y"), (2, 1, "validate", "x"), (2, 2, "delete", None)], "record_id int, seq int, action string, state string")
    assert [(r["record_id"], r["state"]) for r in review.latest(edits).collect()] == [(1, "y")]


def test_confidence_counts_loose_and_strict(spark):
    rows = spark.createDataFrame([("alta", False), ("baja", True), ("mog2", False), ("baja", False)], "level string, ambiguous boolean")
    loose = {r["confidence"]: r["n"] for r in history.confidence_counts(rows).collect()}
    strict = {r["confidence"]: r["n"] for r in history.confidence_counts(rows, strict=True).collect()}
    assert loose == {"alta": 1, "ambiguo": 1, "baja": 2} and strict == {"alta": 1, "ambiguo": 1, "baja": 1}


def test_best_row_ties_and_canonical_names(spark):
    rows = spark.createDataFrame([("m", "b", 0.5), ("m", "a", 0.5), ("n", "z", 0.1)], "model string, classifier string, f1 double")
    best = {r["model"]: r["classifier"] for r in leaderboard.best_per_group(rows, ["model"], "f1", "classifier").collect()}
    assert best == {"m": "a", "n": "z"}
    assert leaderboard.canonical_columns(rows.withColumnRenamed("f1", "F1 Score Macro")).columns[-1] == "F1_Macro"


def test_grid_skips_finished_classifiers(spark):
    from shotline.operators.classifiers import evaluate

    rows = spark.createDataFrame(
        [(i, "ab"[i % 2], [1.0, float(i % 2)], "gallery" if i < 4 else "query") for i in range(8)],
        "item_id bigint, species string, vec array<double>, split string",
    )
    done = spark.createDataFrame([("m", "KNN (k=1)")], "model string, classifier string")
    out = evaluate(rows, "m", ["Nearest Centroid", "KNN (k=1)"], done)
    assert {r["classifier"] for r in out.collect()} == {"Nearest Centroid"}
    assert out.where("y_true = y_pred").count() == 4
    with pytest.raises(ValueError):
        evaluate(rows, "m", ["KNN (k=1)"], done)
