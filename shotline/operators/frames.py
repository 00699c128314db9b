"""Frame selection: sub-sampling and the motion gate.

Frames carry video_id, frame_idx (0, 1, 2, ... inside a video), ts, area and
luminance. Values that belong to a whole video reach its frames by a join on
(video, chunk), so that one very long video is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 1 << 20  # frames of one video handled by one task
WARMUP = 120  # first frames of a video, which always pass
HIGH_AREA, LOW_AREA = 500, 100  # least moving area by lighting
DARK = 60  # mean luminance below which low contrast is assumed
MIN_SAMPLED = 30  # fewer sampled frames switch the gate off
PROBES = 10

# preset name -> (keep every n-th frame, window length, quorum)
PRESETS = {"Básico": (60, 5, 3), "Estándar": (30, 10, 6), "Profundo": (10, 15, 9)}


def chunk_of(frame_idx: str = "frame_idx", span: int = SPAN) -> Column:
    return F.floor(F.col(frame_idx) / F.lit(span))


def subsample(frames: DataFrame, every: int) -> DataFrame:
    return frames.where(F.col("frame_idx") % every == 0)


def video_totals(frames: DataFrame) -> DataFrame:
    return frames.groupBy("video_id").agg((F.max("frame_idx") + 1).alias("total"))


def with_video(frames: DataFrame, videos: DataFrame, span: int = SPAN) -> DataFrame:
    """Attach per-video columns (``videos`` has video_id and total)."""
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total") - 1) / F.lit(span)))
    spread = videos.withColumn("_chunk", F.explode(chunks))
    return frames.withColumn("_chunk", chunk_of(span=span)).join(spread, ["video_id", "_chunk"]).drop("_chunk")


def lighting(frames: DataFrame, span: int = SPAN) -> DataFrame:
    """Mean luminance of the first probes of each video and the lighting it implies."""
    totals = video_totals(frames)
    step = F.greatest(F.lit(1), F.floor(F.col("total") / (2 * PROBES)))
    probed = with_video(frames, totals, span).where(
        (F.col("frame_idx") % step == 0) & (F.col("frame_idx") < step * PROBES)
    )
    means = probed.groupBy("video_id", "total").agg(F.avg("luminance").alias("mean_luminance"))
    return means.withColumn(
        "lighting", F.when(F.col("mean_luminance") < DARK, "low_contrast").otherwise("high_contrast")
    )


def gates(frames: DataFrame, mode: str, every: int, span: int = SPAN) -> DataFrame:
    """Effective gate of each video: ``effective_mode`` and ``min_area`` (null: no gate)."""
    if mode == "adaptive":
        videos = lighting(frames, span)
        chosen = F.concat(F.lit("adaptive_"), F.col("lighting"))
        area = F.when(F.col("lighting") == "high_contrast", HIGH_AREA).otherwise(LOW_AREA)
    else:
        videos = video_totals(frames)
        areas = {"high_contrast": HIGH_AREA, "low_contrast": LOW_AREA}
        chosen = F.lit(mode if mode in areas else "none")
        area = F.lit(areas.get(mode)).cast("int")
    sampled = F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(every)))
    off = sampled < MIN_SAMPLED
    return videos.select(
        "video_id",
        "total",
        sampled.alias("n_sampled"),
        F.when(off, "none").otherwise(chosen).alias("effective_mode"),
        F.when(~off, area).alias("min_area"),
    )


def motion_gate(
    frames: DataFrame, videos: DataFrame, every: int, warmup: int = WARMUP, span: int = SPAN
) -> DataFrame:
    """Sampled frames with ``motion_filtered`` set where too little moves."""
    sampled = with_video(subsample(frames, every), videos.select("video_id", "total", "min_area"), span)
    passes = (
        F.when(F.col("min_area").isNull(), True)
        .when(F.col("frame_idx") < warmup, True)
        .otherwise(F.col("area") >= F.col("min_area"))
    )
    return sampled.withColumn("motion_filtered", ~passes).drop("total", "min_area")
