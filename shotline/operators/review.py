"""Validation of detected events by a person.

A record carries record_id, filename, the event's fields (species, common names,
distance, level, ambiguous, decisor, start_time, end_time, top5), the validation
(state, category, custom_species, validated_species) and extra_species.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotline.functions import labels
from shotline.operators.scan import running
from shotline.session import lookup


def categorise(records: DataFrame, catalogue: DataFrame, typed: str) -> DataFrame:
    """Category of a typed label: unknown, among the candidates, or known otherwise."""
    text = F.lower(F.trim(typed))
    known = catalogue.select(F.lower("species").alias("_key")).where("_key <> ''").distinct()
    joined = records.withColumn("_key", text).join(lookup(known.withColumn("_in", F.lit(True))), "_key", "left")
    listed = F.exists("top5", lambda t: F.lower(t["species"]) == text)
    category = (
        F.when(F.col("_in").isNull(), "Desconocida")
        .when(listed, "Top 5")
        .otherwise("Conocida fuera del top 5")
    )
    return joined.withColumn("category", category).drop("_key", "_in")


def rank_category(rank: Column) -> Column:
    """Category of a candidate picked by its place in the list."""
    return F.when(rank == 1, "Correcta").when(rank > 1, "Top 5")


def reordered_candidates(records: DataFrame) -> DataFrame:
    """Candidates with the predicted species first, keeping its listed distance."""
    top5, predicted = F.col("top5"), F.col("species")
    mine = F.filter(top5, lambda t: t["species"] == predicted)
    distance = F.coalesce(F.get(mine, F.lit(0))["cosine_distance"], F.col("dist"))
    front = F.array(F.struct(predicted.alias("species"), distance.alias("cosine_distance")))
    rest = F.filter(top5, lambda t: t["species"] != predicted)
    first = F.get(top5, F.lit(0))["species"]
    keep = (predicted == "") | predicted.isNull() | (first.isNotNull() & (first == predicted))
    return records.withColumn("candidates", F.when(keep, top5).otherwise(F.concat(front, rest)))


def resolved_species(records: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Final species and its common name: validated, then typed, then predicted."""
    chosen = F.coalesce(F.nullif("validated_species", F.lit("")), F.nullif("custom_species", F.lit("")))
    usable = F.when((F.col("state") == "validated") & ~chosen.isin(labels.NOT_SPECIES), chosen)
    names = catalogue.groupBy(F.col("species").alias("_chosen")).agg(
        F.min(F.struct("nombre_comun_es_ar", "nombre_comun_en")).alias("_n")
    )
    listed = F.coalesce(labels.clean(F.col("_n.nombre_comun_es_ar")), labels.clean(F.col("_n.nombre_comun_en")))
    own = F.coalesce(labels.clean(F.col("es")), labels.clean(F.col("en")))
    joined = records.withColumn("_chosen", usable).join(lookup(names), "_chosen", "left")
    common = F.when(
        F.col("_chosen").isNotNull(),
        F.coalesce(listed, F.when(F.col("_chosen") == F.col("species"), own), F.lit("")),
    ).otherwise(F.coalesce(own, F.lit("")))
    return joined.select(
        *records.columns, common.alias("final_common"), F.coalesce("_chosen", "species").alias("final_species")
    )


def display_labels(catalogue: DataFrame) -> DataFrame:
    """One "common (scientific)" label per species."""
    one = catalogue.where(F.coalesce("species", F.lit("")) != "").groupBy("species").agg(
        F.min("nombre_comun_es_ar").alias("common")
    )
    return one.select("species", labels.display_name(F.col("common"), F.col("species")).alias("display"))


def latest(edits: DataFrame) -> DataFrame:
    """Current state of each record from its append-only edits; deleted records vanish."""
    others = [c for c in edits.columns if c != "record_id"]
    last = edits.groupBy("record_id").agg(F.max_by(F.struct(*others), "seq").alias("e"))
    return last.select("record_id", "e.*").where(F.col("action") != "delete")


def with_multi_species(records: DataFrame) -> DataFrame:
    return records.withColumn("multi_species", F.size("extra_species") > 0)


def search(records: DataFrame, text: str) -> DataFrame:
    name = labels.common_name(F.col("es"), F.col("en"), F.col("species"))
    return records.where(labels.matches(text, F.col("filename"), name, F.col("species")))


def page(records: DataFrame, number: int, size: int = 20, order: str = "record_id") -> DataFrame:
    return records.orderBy(order).offset(number * size).limit(size)


def category_counts(records: DataFrame) -> DataFrame:
    """Validated records per category, including empty categories."""
    done = records.where(F.col("state") == "validated")
    counts = done.groupBy(labels.category_key(F.col("category")).alias("category")).agg(
        F.count(F.lit(1)).alias("n")
    )
    axis = records.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in labels.CATEGORIES])).alias("category")
    )
    return axis.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def name_range(rows: DataFrame, name: str, parts: int = 256) -> Column:
    """Number of the range a name falls into; cut points are ``parts`` names drawn by hash.

    Names with a long common beginning are divided as evenly as any others.
    """
    drawn = rows.select(name).distinct().orderBy(F.xxhash64(name), name).limit(parts)
    cuts = sorted(r[0] for r in drawn.collect() if r[0] is not None)
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(name)))


def unknown_species(records: DataFrame, per_row: int = 1000) -> DataFrame:
    """Typed species outside the catalogue with their record count and sorted files.

    Files are made distinct first and listed ``per_row`` at a time (column
    ``part``), so a species seen in very many files stays spread over tasks.
    """
    rows = records.where(
        (F.col("state") == "validated")
        & (F.col("category") == "Desconocida")
        & (F.coalesce("custom_species", F.lit("")) != "")
    ).withColumnRenamed("custom_species", "especie_ingresada")
    per_file = rows.groupBy("especie_ingresada", "filename").agg(F.count(F.lit(1)).alias("n"))
    numbered = running(
        per_file, ["especie_ingresada"], ["filename"], name_range(per_file, "filename"), sums={"_pos": F.lit(1)}
    )
    listed = numbered.groupBy(
        "especie_ingresada", F.floor((F.col("_pos") - 1) / per_row).alias("part")
    ).agg(
        F.sum("n").alias("_n"),
        F.array_join(F.sort_array(F.collect_list("filename")), ", ").alias("archivos"),
    )
    total = F.sum("_n").over(Window.partitionBy("especie_ingresada"))
    return listed.select("especie_ingresada", "part", total.alias("cantidad_registros"), "archivos")


def top_species(records: DataFrame, n: int) -> DataFrame:
    counted = records.where(F.col("species") != "").groupBy("species").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "species").limit(n)


# --- exports with fixed columns --------------------------------------------------------


def _interval():
    return labels.interval(F.col("start_time"), F.col("end_time"))


def _common():
    return labels.common_name(F.col("es"), F.col("en"), F.col("species"))


def _decisor():
    return labels.decisor(F.col("decisor"), F.col("ambiguous"), F.col("level"))


def _distance():
    return labels.decimals(F.col("dist"), "%.4f")


def validation_export(records: DataFrame) -> DataFrame:
    return records.select(
        F.col("filename").alias("archivo"),
        _interval().alias("intervalo"),
        F.col("species").alias("especie"),
        _common().alias("nombre_comun"),
        labels.confidence(F.col("ambiguous"), F.col("level")).alias("confianza"),
        _decisor().alias("decisor"),
        _distance().alias("distancia_coseno"),
        F.coalesce("category", F.lit("")).alias("validacion"),
        F.coalesce("custom_species", F.lit("")).alias("especie_manual"),
    )


def evaluation_export(records: DataFrame) -> DataFrame:
    return records.select(
        F.col("filename").alias("archivo"),
        _interval().alias("intervalo"),
        labels.expected_species(F.col("category"), F.col("custom_species"), F.col("species")).alias("especie_esperada"),
        F.col("species").alias("especie_predicha"),
        F.col("level").alias("confianza"),
        _distance().alias("distancia_coseno"),
        _decisor().alias("decisor"),
    )


def results_export(records: DataFrame, files: DataFrame) -> DataFrame:
    """Events of completed files."""
    done = files.where(F.col("state") == "completado").select("filename").distinct()
    return records.join(done, "filename", "left_semi").select(
        F.col("filename").alias("archivo"),
        _interval().alias("intervalo"),
        F.col("species").alias("especie"),
        F.col("es").alias("nombre_comun"),
        F.col("level").alias("confianza"),
        F.col("dist").alias("distancia_coseno"),
    )


def multi_species_export(records: DataFrame) -> DataFrame:
    return with_multi_species(records).where("multi_species").select(
        F.col("filename").alias("archivo"),
        _interval().alias("intervalo"),
        F.col("species").alias("especie_principal"),
        _common().alias("nombre_comun"),
        F.array_join("extra_species", ", ").alias("especies_adicionales"),
        _decisor().alias("decisor"),
    )


def unfinished_as_error(files: DataFrame) -> DataFrame:
    """Files whose processing was interrupted come back as errors."""
    broken = F.col("state").isin("error", "procesando")
    return files.withColumn("restored_state", F.when(broken, "error").otherwise(F.col("state")))
