"""Text, category and time labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed labels of the operational tables.
CATEGORIES = ["Correcta", "Top 5", "Conocida", "Desconocida", "Vacío / Ruido"]
NOT_SPECIES = ["Desconocida", "Vacío / Ruido"]
MOTION_MODES = {
    "none": "Ninguno",
    "high_contrast": "Alto contraste",
    "low_contrast": "Bajo contraste",
    "adaptive_high_contrast": "Adaptativo (→ Alto)",
    "adaptive_low_contrast": "Adaptativo (→ Bajo)",
}


def normal_name(name: Column) -> Column:
    return F.lower(F.trim(F.replace(name, F.lit("_"), F.lit(" "))))


def second_candidate(folder: Column, genus: Column) -> Column:
    """Folder name with its genus, unless the folder already contains the genus."""
    return F.when(F.contains(folder, genus), folder).otherwise(F.concat_ws(" ", genus, folder))


def clean(text: Column) -> Column:
    """Null for missing values written as text."""
    return F.when(~F.lower(text).isin("", "nan", "none"), text)


def common_name(spanish: Column, english: Column, species: Column) -> Column:
    return F.coalesce(clean(spanish), clean(english), species)


def decisor(given: Column, ambiguous: Column, level: Column) -> Column:
    return (
        F.when(F.coalesce(given, F.lit("")) != "", given)
        .when(ambiguous, "Consenso")
        .when(level == "alta", "BioCLIP")
        .otherwise("KNN")
    )


def confidence(ambiguous: Column, level: Column) -> Column:
    return F.when(ambiguous, "ambiguo").otherwise(level)


def category_key(category: Column) -> Column:
    known = F.when(category.isin("Correcta", "Top 5", "Desconocida", "Vacío / Ruido"), category)
    return known.when(category.startswith("Conocida"), "Conocida")


def expected_species(category: Column, custom: Column, predicted: Column) -> Column:
    given = F.when(category == "Correcta", predicted).when(category == "Top 5", "— (en top 5)")
    return given.otherwise(F.coalesce(F.nullif(custom, F.lit("")), F.nullif(category, F.lit("")), F.lit("—")))


def clock(seconds: Column) -> Column:
    """Whole seconds, never negative, as m:ss."""
    whole = F.greatest(F.lit(0), seconds.cast("bigint"))
    return F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)


def long_clock(seconds: Column) -> Column:
    """h:mm:ss from one hour on, otherwise m:ss with two-digit minutes."""
    whole = F.greatest(F.lit(0), seconds.cast("bigint"))
    hours, minutes = F.floor(whole / 3600), F.floor(whole % 3600 / 60)
    return F.when(
        hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, whole % 60)
    ).otherwise(F.format_string("%02d:%02d", minutes, whole % 60))


def interval(start: Column, end: Column, dash: str = " – ") -> Column:
    text = F.concat_ws(dash, clock(start), clock(end))
    return F.when(start.isNotNull() & end.isNotNull(), text).otherwise("—")


def speed_factor(processing: Column, duration: Column) -> Column:
    return F.when(duration > 0, F.round(processing / duration, 2))


def distance_band(distance: Column, near: float = 0.1866, middle: float = 0.25) -> Column:
    return F.when(distance < near, "cerca").when(distance < middle, "media").otherwise("lejos")


def motion_mode(mode: Column, legacy: Column) -> Column:
    """Display name of the mode; records of the old form only have a flag."""
    names = F.create_map(*[F.lit(x) for pair in MOTION_MODES.items() for x in pair])
    code = F.coalesce(mode, F.when(legacy, "high_contrast").otherwise("none"))
    return F.coalesce(F.try_element_at(names, code), code)


def slug(name: Column) -> Column:
    text = F.lower(name)
    for old, new in ((" (", "_"), (")", ""), ("=", ""), (" ", "_")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def result_name(stage1: Column, d_gallery: Column, species: Column, d_centroid: Column, name: Column) -> Column:
    rejected = F.format_string("dino%.4f_%s", d_gallery, name)
    label = F.replace(species, F.lit(" "), F.lit("_"))
    accepted = F.format_string("%s_bio%.4f_%s", label, d_centroid, name)
    return F.when(stage1 == "RECHAZADO", rejected).when(species.isNotNull(), accepted)


def decimals(number: Column, pattern: str, missing: str = "—") -> Column:
    """Formatted number, or the text for a missing one."""
    return F.when(number.isNotNull(), F.format_string(pattern, number)).otherwise(missing)


def frame_number(seconds: Column, fps: Column) -> Column:
    return (seconds * fps).cast("bigint")


def clip_name(stem: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s_%ds-%ds.mp4", stem, start.cast("bigint"), end.cast("bigint"))


def matches(text: str, *columns: Column) -> Column:
    """Case-insensitive substring search over several columns; blank text matches all."""
    wanted = text.strip().lower()
    if not wanted:
        return F.lit(True)
    found = F.lit(False)
    for column in columns:
        found = found | F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(wanted))
    return found


def display_name(common: Column, species: Column) -> Column:
    named = clean(common)
    return F.when(named.isNotNull(), F.format_string("%s (%s)", named, species)).otherwise(species)
