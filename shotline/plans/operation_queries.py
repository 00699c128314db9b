"""Run history, validation records and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotline.functions import labels
from shotline.operators import history, review
from shotline.plans import base
from shotline.plans.base import cte, query, twin
from shotline.plans.event_queries import TYPES, _types
from shotline.sources import tables
from shotline.streaming.drain import shared_folder


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# --- records: the events table as reviewed detections -----------------------------------


def records(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = base.table(spark, d, "events").withColumn("k", k)
    name = lambda shift: F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("k") + shift) % 5 + 1)
    turn = F.col("event_id") % 6
    category = (
        F.when(turn == 0, "Correcta")
        .when(turn == 1, "Top 5")
        .when(turn == 2, "Conocida fuera del top 5")
        .when(turn == 3, "Desconocida")
        .when(turn == 4, "Vacío / Ruido")
    )
    custom = F.when(turn == 2, name(1)).when(turn == 3, F.concat(F.lit("nueva "), F.col("k") % 20))
    start = F.col("event_id") % 7200 + F.col("value")
    candidate = lambda shift: F.struct(
        name(shift).alias("species"), (F.col("value") + shift).alias("cosine_distance")
    )
    return rows.select(
        F.col("event_id").alias("record_id"),
        F.concat(F.lit("cam"), "user_id", F.lit(".mp4")).alias("filename"),
        F.when(F.col("k") == 99, "").otherwise(F.col("event_type")).alias("species"),
        F.when(F.col("k") % 4 == 0, "nan").when(F.col("k") % 4 == 1, "").otherwise(F.concat(F.lit("común "), "event_type")).alias("es"),
        F.when(F.col("k") % 3 == 0, "None").otherwise(F.concat(F.lit("name "), "event_type")).alias("en"),
        F.when(F.col("value") <= 30, "alta").otherwise("baja").alias("level"),
        (F.col("k") % 10 == 0).alias("ambiguous"),
        F.when(F.col("k") % 7 == 0, "KNN").otherwise("").alias("decisor"),
        F.col("value").alias("dist"),
        F.when(F.col("k") % 25 != 0, start).alias("start_time"),
        (start + F.col("k")).alias("end_time"),
        F.array(candidate(0), candidate(2), candidate(3)).alias("top5"),
        F.when(F.col("event_id") % 4 == 0, "pending").otherwise("validated").alias("state"),
        category.alias("category"),
        custom.alias("custom_species"),
        F.when(turn == 0, F.col("event_type")).when(turn == 1, name(2)).when(turn.isin(2, 3), custom).when(turn == 4, "Vacío / Ruido").alias("validated_species"),
        F.when(F.col("k") % 8 == 0, F.array(name(1), name(4))).otherwise(F.array().cast("array<string>")).alias("extra_species"),
    )


def _t(shift):
    return f"{_types}[(k + {shift}) % 5 + 1]"


cte(
    "rec",
    f"""SELECT *, CASE WHEN k % 25 <> 0 THEN st END AS start_time, st + k AS end_time, {_t(0)} AS t1, {_t(2)} AS t2, {_t(3)} AS t3,
    CASE turn WHEN 0 THEN event_type WHEN 1 THEN {_t(2)} WHEN 2 THEN custom_species WHEN 3 THEN custom_species WHEN 4 THEN 'Vacío / Ruido' END AS validated_species
    FROM (SELECT *, event_id AS record_id, 'cam' || user_id || '.mp4' AS filename, CASE WHEN k = 99 THEN '' ELSE event_type END AS species,
      CASE k % 4 WHEN 0 THEN 'nan' WHEN 1 THEN '' ELSE 'común ' || event_type END AS es, CASE WHEN k % 3 = 0 THEN 'None' ELSE 'name ' || event_type END AS en,
      CASE WHEN value <= 30 THEN 'alta' ELSE 'baja' END AS level, k % 10 = 0 AS ambiguous, CASE WHEN k % 7 = 0 THEN 'KNN' ELSE '' END AS decisor, value AS dist,
      event_id % 7200 + value AS st, CASE WHEN event_id % 4 = 0 THEN 'pending' ELSE 'validated' END AS state,
      CASE turn WHEN 0 THEN 'Correcta' WHEN 1 THEN 'Top 5' WHEN 2 THEN 'Conocida fuera del top 5' WHEN 3 THEN 'Desconocida' WHEN 4 THEN 'Vacío / Ruido' END AS category,
      CASE turn WHEN 2 THEN {_t(1)} WHEN 3 THEN 'nueva ' || (k % 20) END AS custom_species, CASE WHEN k % 8 = 0 THEN [{_t(1)}, {_t(4)}] ELSE [] END AS extra_species
      FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k, event_id % 6 AS turn FROM events))""",
)
_CLEAN = "CASE WHEN lower({c}) IN ('', 'nan', 'none') THEN NULL ELSE {c} END"
_COMMON = f"coalesce({_CLEAN.format(c='es')}, {_CLEAN.format(c='en')}, species)"
_DECISOR = "CASE WHEN decisor <> '' THEN decisor WHEN ambiguous THEN 'Consenso' WHEN level = 'alta' THEN 'BioCLIP' ELSE 'KNN' END"
_CLOCK = "printf('%d:%02d', greatest(0, trunc({c})::BIGINT) // 60, greatest(0, trunc({c})::BIGINT) % 60)"
_IVL = f"CASE WHEN start_time IS NULL OR end_time IS NULL THEN '—' ELSE {_CLOCK.format(c='start_time')} || '{{dash}}' || {_CLOCK.format(c='end_time')} END"
_DASHED = _IVL.format(dash=" – ")


def _catalogue(spark, d):
    """Catalogue of known species with common names, from the records' own species."""
    rows = records(spark, d).where("species IN ('click', 'view', 'signup')")
    return rows.groupBy("species").agg(
        F.min("es").alias("nombre_comun_es_ar"), F.min("en").alias("nombre_comun_en")
    )


cte(
    "cata",
    "SELECT species, min(es) AS nombre_comun_es_ar, min(en) AS nombre_comun_en FROM rec WHERE species IN ('click', 'view', 'signup') GROUP BY 1",
    "rec",
)


def _project(key, sql, **columns):
    query(key, twin(f"SELECT record_id, {sql} FROM rec", "rec"))(
        lambda spark, d: records(spark, d).select("record_id", *[c().alias(n) for n, c in columns.items()])
    )


c = F.col
_project("p13_common_name", f"{_COMMON} AS common_name", common_name=lambda: labels.common_name(c("es"), c("en"), c("species")))
_project("p14_decisor", f"{_DECISOR} AS decisor", decisor=lambda: labels.decisor(c("decisor"), c("ambiguous"), c("level")))
_project("p15_confidence", "CASE WHEN ambiguous THEN 'ambiguo' ELSE level END AS confidence", confidence=lambda: labels.confidence(c("ambiguous"), c("level")))
_KEY = "CASE WHEN category IN ('Correcta', 'Top 5', 'Desconocida', 'Vacío / Ruido') THEN category WHEN category LIKE 'Conocida%' THEN 'Conocida' END"
_project("p16_category_key", f"{_KEY} AS category_key", category_key=lambda: labels.category_key(c("category")))
_EXPECTED = "CASE WHEN category = 'Correcta' THEN species WHEN category = 'Top 5' THEN '— (en top 5)' ELSE coalesce(custom_species, category, '—') END"
_project(
    "p17_expected_species",
    f"{_EXPECTED} AS expected",
    expected=lambda: labels.expected_species(c("category"), c("custom_species"), c("species")),
)
_project(
    "p22_interval_text",
    f"{_DASHED} AS interval_text, CASE WHEN trunc(end_time)::BIGINT >= 3600 THEN printf('%d:%02d:%02d', trunc(end_time)::BIGINT // 3600, trunc(end_time)::BIGINT % 3600 // 60, trunc(end_time)::BIGINT % 60) ELSE printf('%02d:%02d', trunc(end_time)::BIGINT // 60, trunc(end_time)::BIGINT % 60) END AS end_text",
    interval_text=lambda: labels.interval(c("start_time"), c("end_time")),
    end_text=lambda: labels.long_clock(c("end_time")),
)
_project(
    "p24_distance_band",
    "CASE WHEN dist / 200 < 0.1866 THEN 'cerca' WHEN dist / 200 < 0.25 THEN 'media' ELSE 'lejos' END AS band",
    band=lambda: labels.distance_band(c("dist") / 200),
)
_project(
    "p27_result_name",
    """CASE WHEN dist > 100 THEN printf('dino%.4f_%s', dist, filename) WHEN validated_species IS NOT NULL THEN printf('%s_bio%.4f_%s', replace(validated_species, ' ', '_'), dist, filename) END AS name""",
    name=lambda: labels.result_name(
        F.when(c("dist") > 100, "RECHAZADO").otherwise("PASA"), c("dist"), c("validated_species"), c("dist"), c("filename")
    ),
)
_project(
    "p32_clip_frames",
    "trunc(end_time * 25.0::DOUBLE)::BIGINT AS end_frame, CASE WHEN start_time IS NOT NULL THEN printf('%s_%ds-%ds.mp4', regexp_replace(filename, '\\.[^.]+$', ''), trunc(start_time)::BIGINT, trunc(end_time)::BIGINT) END AS clip",
    end_frame=lambda: labels.frame_number(c("end_time"), F.lit(25.0)),
    clip=lambda: F.when(
        c("start_time").isNotNull(),
        labels.clip_name(F.regexp_replace("filename", r"\.[^.]+$", ""), c("start_time"), c("end_time")),
    ),
)
_project("w20_multi_species", "len(extra_species) > 0 AS multi_species", multi_species=lambda: F.size("extra_species") > 0)


@query(
    "p12_search",
    twin(
        f"SELECT record_id, species FROM rec WHERE contains(lower(filename), 'cam12') OR contains(lower({_COMMON}), 'cam12') OR contains(lower(species), 'cam12')",
        "rec",
    ),
)
def p12(spark, d):
    return review.search(records(spark, d), " CAM12 ").select("record_id", "species")


@query(
    "p12_search_name",
    twin(
        f"SELECT record_id, species FROM rec WHERE contains(lower(filename), 'común v') OR contains(lower({_COMMON}), 'común v') OR contains(lower(species), 'común v')",
        "rec",
    ),
)
def p12_name(spark, d):
    return review.search(records(spark, d), "Común V").select("record_id", "species")


_CHOSEN = "CASE WHEN state = 'validated' AND coalesce(validated_species, custom_species) NOT IN ('Desconocida', 'Vacío / Ruido') THEN coalesce(validated_species, custom_species) END"


@query(
    "p18_resolved_species",
    twin(
        f"""SELECT record_id, coalesce(chosen, species) AS final_species, CASE WHEN chosen IS NOT NULL THEN coalesce({_CLEAN.format(c='nombre_comun_es_ar')}, {_CLEAN.format(c='nombre_comun_en')},
          CASE WHEN chosen = species THEN own END, '') ELSE coalesce(own, '') END AS final_common
        FROM (SELECT rec.*, {_CHOSEN} AS chosen, coalesce({_CLEAN.format(c='es')}, {_CLEAN.format(c='en')}) AS own FROM rec) r
        LEFT JOIN (SELECT species AS csp, nombre_comun_es_ar, nombre_comun_en FROM cata) n ON csp = chosen""",
        "rec",
        "cata",
    ),
)
def p18(spark, d):
    return review.resolved_species(records(spark, d), _catalogue(spark, d)).select("record_id", "final_species", "final_common")


@query(
    "p19_typed_category",
    twin(
        """SELECT record_id, CASE WHEN custom_species NOT IN (SELECT species FROM cata) THEN 'Desconocida' WHEN custom_species IN (t1, t2, t3) THEN 'Top 5' ELSE 'Conocida fuera del top 5' END AS category
        FROM rec WHERE custom_species IS NOT NULL""",
        "rec",
        "cata",
    ),
)
def p19(spark, d):
    rows = records(spark, d).where("custom_species IS NOT NULL").drop("category")
    rows = rows.withColumn("typed", F.concat(F.lit(" "), F.upper("custom_species"), F.lit(" ")))
    return review.categorise(rows, _catalogue(spark, d), "typed").select("record_id", "category")


@query(
    "p19_picked_category",
    twin(
        "SELECT record_id, list_position([t1, t2, t3], validated_species) AS place, CASE WHEN t1 = validated_species THEN 'Correcta' WHEN validated_species IN (t2, t3) THEN 'Top 5' END AS category FROM rec",
        "rec",
    ),
)
def p19_picked(spark, d):
    place = F.array_position(F.transform("top5", lambda t: t["species"]), F.col("validated_species"))
    rows = records(spark, d).select("record_id", F.when(place > 0, place).cast("int").alias("place"))
    return rows.withColumn("category", review.rank_category(F.col("place")))


@query(
    "p20_reordered_candidates",
    twin(
        """SELECT record_id, CASE WHEN species = '' OR t1 = species THEN t1 || ',' || t2 || ',' || t3
          ELSE array_to_string(list_concat([species], list_filter([t1, t2, t3], lambda x: x <> species)), ',') END AS names,
        round(CASE WHEN species = '' OR t1 = species THEN dist WHEN t2 = species THEN dist + 2 WHEN t3 = species THEN dist + 3 ELSE dist END, 6) AS first_distance FROM rec""",
        "rec",
    ),
)
def p20(spark, d):
    out = review.reordered_candidates(records(spark, d))
    return out.select(
        "record_id",
        F.array_join(F.transform("candidates", lambda t: t["species"]), ",").alias("names"),
        F.round(F.element_at("candidates", 1)["cosine_distance"], 6).alias("first_distance"),
    )


@query(
    "p21_display_labels",
    twin(
        f"""SELECT species, CASE WHEN common IS NULL THEN species ELSE common || ' (' || species || ')' END AS display FROM (
          SELECT species, max({_CLEAN.format(c='es')}) AS common FROM rec WHERE species <> '' GROUP BY 1)""",
        "rec",
    ),
)
def p21(spark, d):
    names = records(spark, d).select("species", labels.clean(F.col("es")).alias("nombre_comun_es_ar"))
    return review.display_labels(names)


@query(
    "w21_latest_validation",
    twin(
        """SELECT record_id, state, category FROM (SELECT user_id AS record_id, CASE event_id % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'edit' ELSE 'validate' END AS action,
          CASE WHEN event_id % 5 = 1 THEN 'pending' ELSE 'validated' END AS state, category, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM rec) WHERE r = 1 AND action <> 'delete'""",
        "rec",
    ),
)
def w21(spark, d):
    turn = F.col("record_id") % 5
    edits = records(spark, d).select(
        F.col("filename").alias("record_id"),
        F.col("record_id").alias("seq"),
        F.when(turn == 0, "delete").when(turn == 1, "edit").otherwise("validate").alias("action"),
        F.when(turn == 1, "pending").otherwise("validated").alias("state"),
        "category",
    )
    out = review.latest(edits)
    return out.select(F.regexp_extract("record_id", r"cam(\d+)", 1).cast("bigint").alias("record_id"), "state", "category")


@query("l6_page", twin("SELECT record_id, filename, species FROM rec ORDER BY record_id LIMIT 20 OFFSET 40", "rec"))
def l6(spark, d):
    return review.page(records(spark, d).select("record_id", "filename", "species"), 2)


@query(
    "l4_top_species",
    "SELECT p_name AS species, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 ORDER BY n DESC, species LIMIT 10",
)
def l4(spark, d):
    # counted by part first: the join then carries one row per part, not per line
    lines = base.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    names = base.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("species"))
    counted = lines.join(names, "l_partkey").groupBy("species").agg(F.sum("n").alias("n"))
    return counted.orderBy(F.desc("n"), "species").limit(10)


@query("l4_top_record_species", twin("SELECT species, count(*) AS n FROM rec WHERE species <> '' GROUP BY 1 ORDER BY n DESC, species LIMIT 3", "rec"))
def l4_records(spark, d):
    return review.top_species(records(spark, d), 3)


@query(
    "a34_validation_counts",
    twin(
        f"""SELECT k.category, count(r.category) AS n FROM (SELECT unnest(['Correcta', 'Top 5', 'Conocida', 'Desconocida', 'Vacío / Ruido']) AS category) k
        LEFT JOIN (SELECT {_KEY} AS category FROM rec WHERE state = 'validated') r ON r.category = k.category GROUP BY 1""",
        "rec",
    ),
)
def a34(spark, d):
    return review.category_counts(records(spark, d))


@query(
    "a35_unknown_species",
    twin(
        """SELECT custom_species AS especie_ingresada, 0::BIGINT AS part, sum(n)::BIGINT AS cantidad_registros, string_agg(filename, ', ' ORDER BY filename) AS archivos FROM (
          SELECT custom_species, filename, count(*) AS n FROM rec WHERE state = 'validated' AND category = 'Desconocida' AND custom_species <> '' GROUP BY 1, 2) GROUP BY 1""",
        "rec",
    ),
)
def a35(spark, d):
    return review.unknown_species(records(spark, d), per_row=100_000)


# --- history: orders as runs, line items as files -----------------------------------------


def runs(spark, d):
    priority = F.col("o_orderpriority")
    return base.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").alias("ts"),
        F.when(priority == "1-URGENT", "Básico").when(priority == "2-HIGH", "Estándar").otherwise("Profundo").alias("mode"),
        F.when(F.col("o_orderstatus") == "F", "sliding").otherwise("static").alias("consensus_mode"),
        F.when(F.col("o_orderstatus") == "P", "adaptive_low_contrast").otherwise("low_contrast").alias("session_motion_mode"),
    )


cte(
    "runs",
    """SELECT o_orderkey AS run_id, o_orderdate AS ts, CASE o_orderpriority WHEN '1-URGENT' THEN 'Básico' WHEN '2-HIGH' THEN 'Estándar' ELSE 'Profundo' END AS mode,
    CASE WHEN o_orderstatus = 'F' THEN 'sliding' ELSE 'static' END AS consensus_mode, CASE WHEN o_orderstatus = 'P' THEN 'adaptive_low_contrast' ELSE 'low_contrast' END AS session_motion_mode FROM orders""",
)


def files(spark, d):
    video = F.col("l_linenumber") % 2 == 1
    return base.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.concat(F.lit("cam"), "l_suppkey", F.lit("_"), "l_partkey", F.when(video, ".mp4").otherwise(".jpg")).alias("filename"),
        F.when(F.col("l_returnflag") == "N", "completado").when(F.col("l_returnflag") == "A", "error").otherwise("procesando").alias("state"),
        F.when(video, F.col("l_quantity")).alias("duration_sec"),
        F.when(F.col("l_tax") < 0.07, F.col("l_extendedprice") / 1024).alias("processing_sec"),
        F.when(F.col("l_discount") >= 0.02, F.col("l_quantity").cast("bigint")).alias("frames"),
        F.when(F.col("l_linestatus") == "F", "high_contrast").alias("motion_mode"),
    )


cte(
    "files",
    """SELECT l_orderkey AS run_id, 'cam' || l_suppkey || '_' || l_partkey || CASE WHEN l_linenumber % 2 = 1 THEN '.mp4' ELSE '.jpg' END AS filename,
    CASE l_returnflag WHEN 'N' THEN 'completado' WHEN 'A' THEN 'error' ELSE 'procesando' END AS state, CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END AS duration_sec,
    CASE WHEN l_tax < 0.07 THEN l_extendedprice / 1024 END AS processing_sec, CASE WHEN l_discount >= 0.02 THEN l_quantity::BIGINT END AS frames,
    CASE WHEN l_linestatus = 'F' THEN 'high_contrast' END AS motion_mode FROM lineitem""",
)
cte(
    "lat",
    """SELECT f.run_id, filename, CASE WHEN duration_sec IS NULL THEN 'imagen' ELSE 'video' END AS type, duration_sec, mode, consensus_mode,
    coalesce(motion_mode, CASE WHEN duration_sec IS NULL THEN 'none' ELSE session_motion_mode END) AS motion_filter_mode, frames AS frames_processed, processing_sec
    FROM files f JOIN runs r ON r.run_id = f.run_id WHERE state = 'completado' AND processing_sec IS NOT NULL""",
    "files",
    "runs",
)


def latency(spark, d):
    return history.latency_records(runs(spark, d), files(spark, d))


@query(
    "a36_history_totals",
    twin(
        """SELECT (SELECT count(*) FROM runs) AS total_runs, (SELECT sum(coalesce(frames, 1))::BIGINT FROM files) AS total_frames, count(*) AS total_records,
        count(*) FILTER (state = 'validated') AS total_validations FROM rec""",
        "runs",
        "files",
        "rec",
    ),
)
def a36(spark, d):
    return history.totals(runs(spark, d), files(spark, d), records(spark, d))


@query(
    "a36_run_rows",
    twin(
        """SELECT r.run_id, count(f.run_id) AS n_files, CASE WHEN coalesce(max(CASE WHEN f.state = 'error' THEN 1 ELSE 0 END), 0) = 1 THEN 'error' ELSE 'completado' END AS run_state
        FROM runs r LEFT JOIN files f ON f.run_id = r.run_id GROUP BY r.run_id""",
        "runs",
        "files",
    ),
)
def a36_rows(spark, d):
    return history.run_rows(runs(spark, d), files(spark, d)).select("run_id", "n_files", "run_state")


@query("a37_species_counts", twin("SELECT species, count(*) AS n FROM rec WHERE species <> '' GROUP BY 1", "rec"))
def a37(spark, d):
    return history.species_counts(records(spark, d))


@query(
    "a37_confidence_counts",
    twin("SELECT CASE WHEN ambiguous THEN 'ambiguo' WHEN level = 'alta' THEN 'alta' ELSE 'baja' END AS confidence, count(*) AS n FROM rec GROUP BY 1", "rec"),
)
def a37_confidence(spark, d):
    return history.confidence_counts(records(spark, d))


@query("a38_latency_records", twin("SELECT * FROM lat", "lat"))
def a38(spark, d):
    return latency(spark, d)


@query("a39_runs_per_day", twin("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM runs GROUP BY 1", "runs"))
def a39(spark, d):
    return history.runs_per_day(runs(spark, d)).withColumn("day", F.col("day").cast("string"))


@query(
    "a40_file_detail",
    twin(
        """SELECT filename, array_to_string(list_sort(list_distinct(list(species) FILTER (species <> ''))), ', ') AS species_found, count(*) AS n_events,
        count(*) FILTER (level = 'alta') AS n_alta, count(*) FILTER (level <> 'alta') AS n_other, round(avg(dist), 8) AS mean_distance FROM rec GROUP BY filename""",
        "rec",
    ),
)
def a40(spark, d):
    return history.file_detail(records(spark, d)).withColumn("mean_distance", F.round("mean_distance", 8))


@query(
    "a41_batch_summary",
    twin(
        "SELECT count(*) FILTER (state = 'completado') AS n_completed, count(*) FILTER (state = 'error') AS n_error, sum(frames)::BIGINT AS n_frames, count(*) AS n_files FROM files",
        "files",
    ),
)
def a41(spark, d):
    return history.batch_summary(files(spark, d))


def outcomes(spark, d):
    """Two-stage results of line items: folder, gate outcome, confidence outcome."""
    gate = F.when(F.col("l_discount") > 0.08, "RECHAZADO").when(F.col("l_tax") >= 0.01, "PASA").otherwise("")
    stage2 = F.when(F.col("l_quantity") > 25, "BAJA_CONFIANZA").otherwise("ALTA_CONFIANZA")
    return (
        base.table(spark, d, "lineitem")
        .select(F.col("l_returnflag").alias("folder"), gate.alias("stage1"), stage2.alias("s2"))
        .select("folder", "stage1", F.when(F.col("stage1") == "PASA", F.col("s2")).otherwise("N/A").alias("stage2"))
    )


cte(
    "outc",
    """SELECT folder, stage1, CASE WHEN stage1 = 'PASA' THEN s2 ELSE 'N/A' END AS stage2 FROM (SELECT l_returnflag AS folder,
      CASE WHEN l_discount > 0.08 THEN 'RECHAZADO' WHEN l_tax >= 0.01 THEN 'PASA' ELSE '' END AS stage1, CASE WHEN l_quantity > 25 THEN 'BAJA_CONFIANZA' ELSE 'ALTA_CONFIANZA' END AS s2 FROM lineitem)""",
)


@query(
    "a42_folder_outcomes",
    twin(
        """SELECT *, round(rechazados / total::DOUBLE * 100, 6) AS rechazados_pct, round(pasan / total::DOUBLE * 100, 6) AS pasan_pct, round(alta / total::DOUBLE * 100, 6) AS alta_pct,
        round(baja / total::DOUBLE * 100, 6) AS baja_pct FROM (SELECT folder, count(*) AS total, count(*) FILTER (stage1 = 'RECHAZADO') AS rechazados, count(*) FILTER (stage1 = 'PASA') AS pasan,
          count(*) FILTER (stage2 = 'ALTA_CONFIANZA') AS alta, count(*) FILTER (stage2 = 'BAJA_CONFIANZA') AS baja FROM outc GROUP BY folder)""",
        "outc",
    ),
)
def a42(spark, d):
    out = history.folder_outcomes(outcomes(spark, d))
    return out.withColumns({n: F.round(n, 6) for n in out.columns if n.endswith("_pct")})


@query(
    "a43_copy_counters",
    twin(
        """SELECT f.folder, o.outcome, count(c.folder) AS n FROM (SELECT DISTINCT folder FROM outc) f, (SELECT unnest(['RECHAZADO', 'ALTA_CONFIANZA', 'BAJA_CONFIANZA']) AS outcome) o
        LEFT JOIN (SELECT folder, CASE WHEN stage1 = 'RECHAZADO' THEN stage1 ELSE stage2 END AS outcome FROM outc) c ON c.folder = f.folder AND c.outcome = o.outcome GROUP BY 1, 2""",
        "outc",
    ),
)
def a43(spark, d):
    return history.copy_counters(outcomes(spark, d))


@query(
    "a47_events_by_file",
    twin("SELECT filename, record_id, species, row_number() OVER (PARTITION BY filename ORDER BY record_id) AS position FROM rec", "rec"),
)
def a47(spark, d):
    rows = records(spark, d).select("filename", "record_id", "species")
    return history.events_by_file(rows)


@query(
    "a47_restored_files",
    twin("SELECT state, CASE WHEN state IN ('error', 'procesando') THEN 'error' ELSE state END AS restored_state, count(*) AS n FROM files GROUP BY 1, 2", "files"),
)
def a47_files(spark, d):
    out = review.unfinished_as_error(files(spark, d))
    return out.groupBy("state", "restored_state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a48_running_progress",
    twin("SELECT count(DISTINCT species) FILTER (species <> '') AS species_seen, (SELECT sum(coalesce(frames, 1))::BIGINT FROM files) AS total_frames FROM rec", "rec", "files"),
)
def a48(spark, d):
    return history.running_progress(files(spark, d), records(spark, d))


@query(
    "a49_overall_totals",
    twin(
        "SELECT count(*) FILTER (record_id % 2 = 0) AS n_records, count(*) FILTER (state = 'validated') AS n_validations FROM rec",
        "rec",
    ),
)
def a49(spark, d):
    rows = records(spark, d)
    stored, session = rows.where("record_id % 2 = 0"), rows.where("record_id % 2 = 1")
    return history.overall(stored, session)


@query(
    "a50_file_intervals",
    twin(
        f"""SELECT filename, (pos - 1) // 20 AS part, any_value(n_species) AS n_species, string_agg({_IVL.format(dash='–')}, ', ' ORDER BY pos) AS intervals FROM (
          SELECT *, row_number() OVER (PARTITION BY filename ORDER BY record_id) AS pos FROM rec) JOIN (SELECT filename, count(DISTINCT species) FILTER (species <> '') AS n_species FROM rec GROUP BY 1) USING (filename)
        GROUP BY 1, 2""",
        "rec",
    ),
)
def a50(spark, d):
    return history.file_intervals(records(spark, d), per_row=20)


@query(
    "p23_speed_factor",
    twin("SELECT run_id, filename, CASE WHEN duration_sec > 0 THEN round(processing_sec / duration_sec, 2) END AS factor FROM files", "files"),
)
def p23(spark, d):
    return files(spark, d).select("run_id", "filename", labels.speed_factor(F.col("processing_sec"), F.col("duration_sec")).alias("factor"))


_MODE = (
    "CASE coalesce({m}, CASE WHEN {f} THEN 'high_contrast' ELSE 'none' END) "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.MOTION_MODES.items())
    + " ELSE {m} END"
)


@query(
    "p25_motion_mode",
    twin(f"SELECT run_id, filename, {_MODE.format(m='motion_mode', f='(duration_sec > 20)')} AS label FROM files", "files"),
)
def p25(spark, d):
    return files(spark, d).select(
        "run_id", "filename", labels.motion_mode(F.col("motion_mode"), F.col("duration_sec") > 20).alias("label")
    )


@query(
    "p26_slug",
    "SELECT p_partkey, replace(replace(replace(replace(lower(p_brand || ' ' || p_type || ' (k=' || p_size || ')'), ' (', '_'), ')', ''), '=', ''), ' ', '_') AS slug FROM part",
)
def p26(spark, d):
    name = F.concat("p_brand", F.lit(" "), "p_type", F.lit(" (k="), "p_size", F.lit(")"))
    return base.table(spark, d, "part").select("p_partkey", labels.slug(name).alias("slug"))


def _incoming(spark, d):
    return base.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(
        F.concat(F.lit("cam"), "l_suppkey", F.lit("_"), "l_partkey", F.lit(".mp4")).alias("filename"), "l_orderkey", "l_linenumber"
    )


cte(
    "incoming",
    "SELECT 'cam' || l_suppkey || '_' || l_partkey || '.mp4' AS filename, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'",
)


@query("j8_known_files", twin("SELECT * FROM incoming WHERE filename IN (SELECT filename FROM lat)", "incoming", "lat"))
def j8_known(spark, d):
    return history.known_files(_incoming(spark, d), latency(spark, d))


@query("j8_new_files", twin("SELECT * FROM incoming WHERE filename NOT IN (SELECT filename FROM lat)", "incoming", "lat"))
def j8_new(spark, d):
    return history.new_files(_incoming(spark, d), latency(spark, d))


# --- exports ---------------------------------------------------------------------------


@query(
    "s8_validation_export",
    twin(
        f"""SELECT filename AS archivo, {_DASHED} AS intervalo, species AS especie, {_COMMON} AS nombre_comun, CASE WHEN ambiguous THEN 'ambiguo' ELSE level END AS confianza,
        {_DECISOR} AS decisor, printf('%.4f', dist) AS distancia_coseno, coalesce(category, '') AS validacion, coalesce(custom_species, '') AS especie_manual FROM rec""",
        "rec",
    ),
)
def s8_validation(spark, d):
    return review.validation_export(records(spark, d))


@query(
    "s8_evaluation_export",
    twin(
        f"""SELECT filename AS archivo, {_DASHED} AS intervalo, {_EXPECTED} AS especie_esperada, species AS especie_predicha, level AS confianza, printf('%.4f', dist) AS distancia_coseno,
        {_DECISOR} AS decisor FROM rec""",
        "rec",
    ),
)
def s8_evaluation(spark, d):
    return review.evaluation_export(records(spark, d))


@query(
    "s8_results_export",
    twin(
        f"""SELECT filename AS archivo, {_DASHED} AS intervalo, species AS especie, es AS nombre_comun, level AS confianza, dist AS distancia_coseno FROM rec
        WHERE filename IN (SELECT 'cam' || l_suppkey || '.mp4' FROM lineitem WHERE l_returnflag = 'N')""",
        "rec",
    ),
)
def s8_results(spark, d):
    done = base.table(spark, d, "lineitem").select(
        F.concat(F.lit("cam"), "l_suppkey", F.lit(".mp4")).alias("filename"),
        F.when(F.col("l_returnflag") == "N", "completado").otherwise("error").alias("state"),
    )
    return review.results_export(records(spark, d), done)


@query(
    "s8_multi_species_export",
    twin(
        f"""SELECT filename AS archivo, {_DASHED} AS intervalo, species AS especie_principal, {_COMMON} AS nombre_comun, array_to_string(extra_species, ', ') AS especies_adicionales,
        {_DECISOR} AS decisor FROM rec WHERE len(extra_species) > 0""",
        "rec",
    ),
)
def s8_multi(spark, d):
    return review.multi_species_export(records(spark, d))


@query(
    "s8_latency_export",
    twin(
        f"""SELECT filename AS archivo, type AS tipo, CASE WHEN duration_sec IS NULL THEN '—' ELSE {_CLOCK.format(c='duration_sec')} END AS duracion, mode AS modo,
        CASE WHEN consensus_mode = 'sliding' THEN 'Deslizante' ELSE 'Estático' END AS consenso, {_MODE.format(m='motion_filter_mode', f='false')} AS filtro_mog2,
        coalesce(frames_processed::VARCHAR, '—') AS frames_analizados, {_CLOCK.format(c='processing_sec')} AS tiempo_procesamiento,
        CASE WHEN duration_sec > 0 THEN printf('%.2f×', round(processing_sec / duration_sec, 2)) ELSE '—' END AS factor FROM lat""",
        "lat",
    ),
)
def s8_latency(spark, d):
    return history.latency_export(latency(spark, d))


@query(
    "s9_markdown_rows",
    "SELECT '| ' || c_custkey || ' | ' || c_name || ' | ' || c_mktsegment || ' |' AS line FROM customer",
)
def s9(spark, d):
    return tables.markdown_rows(base.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"))


cte(
    "thr",
    """SELECT l_returnflag AS model, p AS percentile, round(avg(l_extendedprice) FILTER (l_linenumber <= rank), 2) AS threshold, round(count(*) FILTER (l_linenumber <= rank) / count(*)::DOUBLE, 6) AS coverage,
    round(count(*) FILTER (l_linenumber > rank) / count(*)::DOUBLE, 6) AS inter_contamination, round(avg(l_quantity) - rank, 6) AS separation_gap
    FROM lineitem, (VALUES ('p90', 2), ('p95', 3), ('p99', 4)) v(p, rank) GROUP BY l_returnflag, p, rank""",
)


def threshold_table(spark, d):
    steps = F.array(*[F.struct(F.lit(p).alias("percentile"), F.lit(r).alias("rank")) for p, r in (("p90", 2), ("p95", 3), ("p99", 4))])
    rows = base.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("model"), "l_extendedprice", "l_linenumber", "l_quantity", F.inline(steps)
    )
    low = F.col("l_linenumber") <= F.col("rank")
    return rows.groupBy("model", "percentile", "rank").agg(
        F.round(F.avg(F.when(low, F.col("l_extendedprice"))), 2).alias("threshold"),
        F.round(F.avg(low.cast("double")), 6).alias("coverage"),
        F.round(F.avg((~low).cast("double")), 6).alias("inter_contamination"),
        F.round(F.avg("l_quantity") - F.first("rank"), 6).alias("separation_gap"),
    ).drop("rank")


@query(
    "s6_threshold_documents",
    twin("SELECT model, percentile, threshold, coverage, inter_contamination, separation_gap FROM thr", "thr"),
)
def s6(spark, d):
    """Threshold tables to JSON documents and back."""
    documents = tables.threshold_documents(threshold_table(spark, d), ["model"])
    return tables.read_threshold_documents(documents, ["model"])


@query(
    "s5_csv_sink",
    "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer",
)
def s5(spark, d):
    """Written as CSV and read back with its schema."""
    rows = base.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    target = shared_folder(spark)
    tables.write_csv(rows, target)
    return tables.read_csv(spark, target, rows.schema)


@query(
    "s7_partitioned_arrays",
    "SELECT l_returnflag AS model, l_linestatus AS metric, l_orderkey, l_linenumber, l_discount AS distance FROM lineitem WHERE l_returnflag = 'N'",
)
def s7(spark, d):
    """Written by model and metric, read back with the partitions pruned."""
    rows = base.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("model"),
        F.col("l_linestatus").alias("metric"),
        "l_orderkey",
        "l_linenumber",
        F.col("l_discount").alias("distance"),
    )
    target = shared_folder(spark)
    tables.write_long_arrays(rows, target)
    return spark.read.parquet(target).where("model = 'N'")


@query(
    "x5_builtin_aggregates",
    """SELECT l_returnflag AS label, round(sum(1 / (l_discount + 1e-6)), 2) AS weight, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1""",
)
def x5(spark, d):
    """Weighted votes as built-in aggregates, no user-defined ones."""
    return base.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("label")).agg(
        F.round(F.sum(1 / (F.col("l_discount") + 1e-6)), 2).alias("weight"),
        F.round(F.avg("l_quantity"), 6).alias("mean"),
    )
