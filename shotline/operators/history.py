"""Run history as append-only facts: runs, their files, their event records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotline.functions import labels
from shotline.operators import scan
from shotline.session import side_by_side

SPAN = 1 << 20  # records of one file handled by one task


def run_rows(runs: DataFrame, files: DataFrame) -> DataFrame:
    """One row per run with its files counted; a run with a failed file is an error."""
    per_run = files.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.max((F.col("state") == "error").cast("int")).alias("_bad")
    )
    joined = runs.join(per_run, "run_id", "left")
    return joined.select(
        *runs.columns,
        F.coalesce("n_files", F.lit(0)).alias("n_files"),
        F.when(F.col("_bad") == 1, "error").otherwise("completado").alias("run_state"),
    )


def totals(runs: DataFrame, files: DataFrame, records: DataFrame) -> DataFrame:
    """Runs, frames (one for a file without a count), records and validations."""
    return side_by_side(
        runs.agg(F.count(F.lit(1)).alias("total_runs")),
        files.agg(F.sum(F.coalesce("frames", F.lit(1))).alias("total_frames")),
        records.agg(
            F.count(F.lit(1)).alias("total_records"),
            F.count_if(F.col("state") == "validated").alias("total_validations"),
        ),
    )


def species_counts(records: DataFrame) -> DataFrame:
    return records.where(F.coalesce("species", F.lit("")) != "").groupBy("species").agg(
        F.count(F.lit(1)).alias("n")
    )


def confidence_counts(records: DataFrame, strict: bool = False) -> DataFrame:
    """Ambiguous, high, and everything else as low (``strict``: only real low levels)."""
    other = F.when(F.col("level") == "baja", "baja") if strict else F.lit("baja")
    key = (
        F.when(F.col("ambiguous"), "ambiguo")
        .when(F.col("level") == "alta", "alta")
        .otherwise(other)
    )
    return records.groupBy(key.alias("confidence")).agg(F.count(F.lit(1)).alias("n")).where(
        "confidence IS NOT NULL"
    )


def latency_records(runs: DataFrame, files: DataFrame) -> DataFrame:
    """Timing facts of completed files with a processing time."""
    video = F.col("duration_sec").isNotNull()
    usable = files.where((F.col("state") == "completado") & F.col("processing_sec").isNotNull())
    session = F.when(video, F.col("session_motion_mode")).otherwise("none")
    return usable.join(runs.select("run_id", "mode", "consensus_mode", "session_motion_mode"), "run_id").select(
        "run_id",
        "filename",
        F.when(video, "video").otherwise("imagen").alias("type"),
        "duration_sec",
        "mode",
        "consensus_mode",
        F.coalesce("motion_mode", session).alias("motion_filter_mode"),
        F.col("frames").alias("frames_processed"),
        "processing_sec",
    )


def latency_export(latency: DataFrame) -> DataFrame:
    factor = labels.speed_factor(F.col("processing_sec"), F.col("duration_sec"))
    return latency.select(
        F.col("filename").alias("archivo"),
        F.col("type").alias("tipo"),
        F.when(F.col("duration_sec").isNull(), "—").otherwise(labels.clock(F.col("duration_sec"))).alias("duracion"),
        F.col("mode").alias("modo"),
        F.when(F.col("consensus_mode") == "sliding", "Deslizante").otherwise("Estático").alias("consenso"),
        labels.motion_mode(F.col("motion_filter_mode"), F.lit(False)).alias("filtro_mog2"),
        F.coalesce(F.col("frames_processed").cast("string"), F.lit("—")).alias("frames_analizados"),
        labels.clock(F.col("processing_sec")).alias("tiempo_procesamiento"),
        labels.decimals(factor, "%.2f×").alias("factor"),
    )


def runs_per_day(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def file_detail(records: DataFrame) -> DataFrame:
    """Per file: species found, events, confidence split and mean distance."""
    per_species = records.groupBy("filename", "species").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("level") == "alta").alias("alta"),
        F.sum("dist").alias("d"),
        F.count("dist").alias("nd"),
    )
    named = F.when(F.col("species") != "", F.col("species"))
    return per_species.groupBy("filename").agg(
        F.array_join(F.sort_array(F.collect_set(named)), ", ").alias("species_found"),
        F.sum("n").alias("n_events"),
        F.sum("alta").alias("n_alta"),
        F.sum(F.col("n") - F.col("alta")).alias("n_other"),
        (F.sum("d") / F.sum("nd")).alias("mean_distance"),
    )


def batch_summary(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count_if(F.col("state") == "completado").alias("n_completed"),
        F.count_if(F.col("state") == "error").alias("n_error"),
        F.sum("frames").alias("n_frames"),
        F.count(F.lit(1)).alias("n_files"),
    )


def folder_outcomes(results: DataFrame) -> DataFrame:
    """Counts and percentages of two-stage outcomes per folder."""
    share = lambda c: (F.col(c) / F.col("total") * 100).alias(f"{c}_pct")
    counted = results.groupBy("folder").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("stage1") == "RECHAZADO").alias("rechazados"),
        F.count_if(F.col("stage1") == "PASA").alias("pasan"),
        F.count_if(F.col("stage2") == "ALTA_CONFIANZA").alias("alta"),
        F.count_if(F.col("stage2") == "BAJA_CONFIANZA").alias("baja"),
    )
    return counted.select("*", share("rechazados"), share("pasan"), share("alta"), share("baja"))


OUTCOMES = ["RECHAZADO", "ALTA_CONFIANZA", "BAJA_CONFIANZA"]


def copy_counters(results: DataFrame) -> DataFrame:
    """Folder x outcome counts on the whole grid; rows without an outcome are left out."""
    outcome = F.when(F.col("stage1") == "RECHAZADO", "RECHAZADO").when(
        F.col("stage2").isin("ALTA_CONFIANZA", "BAJA_CONFIANZA"), F.col("stage2")
    )
    counts = results.groupBy("folder", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select("folder").distinct().withColumn(
        "outcome", F.explode(F.array(*[F.lit(o) for o in OUTCOMES]))
    )
    return grid.join(counts, ["folder", "outcome"], "left").select(
        "folder", "outcome", F.coalesce("n", F.lit(0)).alias("n")
    )


def running_progress(files: DataFrame, records: DataFrame) -> DataFrame:
    """Distinct species seen and frames processed (one for a file without a count)."""
    seen = records.where(F.coalesce("species", F.lit("")) != "").agg(
        F.count_distinct("species").alias("species_seen")
    )
    frames = files.agg(F.sum(F.coalesce("frames", F.lit(1))).alias("total_frames"))
    return side_by_side(seen, frames)


def overall(history: DataFrame, session_records: DataFrame) -> DataFrame:
    """Stored validations plus those of the running session."""
    facts = history.select(F.lit(1).alias("record"), (F.col("state") == "validated").cast("int").alias("ok"))
    session = session_records.select(F.lit(0).alias("record"), (F.col("state") == "validated").cast("int").alias("ok"))
    return facts.unionByName(session).agg(F.sum("record").alias("n_records"), F.sum("ok").alias("n_validations"))


def file_intervals(records: DataFrame, per_row: int = 1000) -> DataFrame:
    """Species count of each file and its interval texts, ``per_row`` joined per row.

    An ordinary file has one row (``part`` 0); a file with very many events
    continues in further rows instead of one unbounded text.
    """
    text = labels.interval(F.col("start_time"), F.col("end_time"), "–")
    numbered = scan.numbered(records.withColumn("_text", text), ["filename"], "record_id", SPAN, "_pos")
    parts = numbered.groupBy("filename", F.floor((F.col("_pos") - 1) / per_row).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("_pos", "_text"))).alias("t")
    )
    species = records.groupBy("filename").agg(
        F.count_distinct(F.when(F.col("species") != "", F.col("species"))).alias("n_species")
    )
    joined = F.array_join(F.transform("t", lambda x: x["_text"]), ", ")
    return parts.join(species, "filename").select("filename", "part", "n_species", joined.alias("intervals"))


def known_files(files: DataFrame, latency: DataFrame) -> DataFrame:
    """Files that were processed before (duplicates)."""
    return files.join(latency.select("filename").distinct(), "filename", "left_semi")


def new_files(files: DataFrame, latency: DataFrame) -> DataFrame:
    return files.join(latency.select("filename").distinct(), "filename", "left_anti")


def events_by_file(records: DataFrame) -> DataFrame:
    """Records regrouped by file: each with its position in the file's list."""
    return scan.numbered(records, ["filename"], "record_id", SPAN, "position")
