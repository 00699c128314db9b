"""Structured Streaming queries, driven to completion over the supplied files."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotline.operators import centroid, history
from shotline.plans import base, event_queries, operation_queries
from shotline.plans.base import query, twin
from shotline.plans.vector_queries import CONFIDENT, REJECTED
from shotline.session import materialize
from shotline.streaming import aggregates
from shotline.streaming.drain import drain, shared_folder, upserted
from shotline.streaming.events import detect_events, window_events


def stream(spark, folder, name):
    """A supplied table as a stream; the pattern matches its name alone, be it one file or a folder of parts."""
    schema = base.table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/[{name[0]}]{name[1:]}.parquet")


def _frames(rows):
    return rows.select(
        F.col("user_id").alias("video_id"),
        F.col("event_id").alias("frame_idx"),
        (F.col("event_id") / 4.0).alias("ts"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.col("event_type").alias("species"),
        F.col("value").alias("dist"),
        F.when(F.col("value") <= 30, "alta").when(F.col("value") >= event_queries.REJECT, "rechazado").otherwise("baja").alias("level"),
        (F.get_json_object("props", "$.k").cast("int") < 10).alias("motion_filtered"),
    )


DISORDER = "400 days"  # the supplied events span one year


def arrivals(spark, rows, key, parts, last=None):
    """``rows`` as a stream of ``parts`` shuffled sets, then ``last``; a batch takes as many files as a set has.

    A set has a file for each task that wrote it. The batches follow the sets, however many
    files a large table is written in.
    """
    target = shared_folder(spark)
    sets = [rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]
    for i, part in enumerate(sets if last is None else [*sets, last]):
        part.write.parquet(f"{target}/{i}")
    files = max(len(spark.read.schema(rows.schema).parquet(f"{target}/{i}").inputFiles()) for i in range(parts))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, files)).parquet(f"{target}/*")


def frame_stream(spark, d, parts=2):
    """Frames of all videos in ``parts`` shuffled sets of files, then one row that moves the watermark on."""
    rows = base.table(spark, d, "events")
    far = rows.orderBy(F.desc("ts")).limit(1).withColumns(
        {"user_id": F.lit(-1).cast("bigint"), "ts": F.col("ts") + F.expr("INTERVAL 900 DAYS"), "value": F.lit(0.0)}
    )
    return _frames(arrivals(spark, rows, "event_id", parts, far))


def _kept(rows):
    """Rejected frames leave the stream before any consensus."""
    return rows.where("motion_filtered OR level <> 'rechazado'")


def _events(spark, d, parts=2):
    return detect_events(
        _kept(frame_stream(spark, d, parts)), event_queries.QUORUM, event_queries.CLOSING, event_queries.THRESHOLD, DISORDER
    )


@query(
    "t1_stream_events",
    twin(
        """SELECT e.video_id, e.species, f.event_id AS representative_id, f.dist AS cosine_distance, e.ambiguous, e.n_frames, e.n_hits
        FROM sev2 e JOIN fr f ON f.video_id = e.video_id AND f.frame_idx = e.representative_frame_idx""",
        "sev2",
        "fr",
    ),
)
def t1(spark, d):
    found = _events(spark, d)
    return drain(found).select(
        "video_id",
        "species",
        F.col("representative_frame_idx").alias("representative_id"),
        "cosine_distance",
        "ambiguous",
        "n_frames",
        "n_hits",
    )


@query(
    "t2_stream_windows",
    twin(
        """SELECT w.video_id, window_no, w.species, f.event_id AS representative_id, ambiguous, n_frames
        FROM wev w JOIN fr f ON f.video_id = w.video_id AND f.frame_idx = w.representative_frame_idx""",
        "wev",
        "fr",
    ),
)
def t2(spark, d):
    found = window_events(_kept(frame_stream(spark, d)), event_queries.WINDOW, event_queries.QUORUM + 1, DISORDER)
    return drain(found).select(
        "video_id",
        "window_no",
        "species",
        F.col("representative_frame_idx").alias("representative_id"),
        "ambiguous",
        "n_frames",
    )


@query("t3_end_of_video_flush", twin("SELECT video_id, species, n_hits FROM sev2 WHERE ambiguous", "sev2"))
def t3(spark, d):
    """Events that exist only because a video ended before the quorum."""
    found = _events(spark, d)
    return drain(found).where("ambiguous").select("video_id", "species", "n_hits")


@query(
    "t4_out_of_order_frames",
    twin("SELECT video_id, species, ambiguous, n_frames, n_hits FROM sev2", "sev2"),
)
def t4(spark, d):
    """Events from frames that come in any order; the watermark delay covers the disorder."""
    found = _events(spark, d, 4)
    return drain(found).select("video_id", "species", "ambiguous", "n_frames", "n_hits")


def _records(spark, d, parts=5):
    """The record columns the history needs, from the event stream in several batches."""
    k = F.get_json_object("props", "$.k").cast("int")
    return arrivals(spark, base.table(spark, d, "events"), "event_id", parts).select(
        F.when(k == 99, "").otherwise(F.col("event_type")).alias("species"),
        F.when(F.col("value") <= 30, "alta").otherwise("baja").alias("level"),
        (k % 10 == 0).alias("ambiguous"),
    )


@query("t5_running_species", twin("SELECT species, count(*) AS n FROM rec WHERE species <> '' GROUP BY 1", "rec"))
def t5_species(spark, d):
    return upserted(history.species_counts(_records(spark, d)), ["species"], every=2)


@query(
    "t5_running_confidence",
    twin("SELECT CASE WHEN ambiguous THEN 'ambiguo' WHEN level = 'alta' THEN 'alta' ELSE 'baja' END AS confidence, count(*) AS n FROM rec GROUP BY 1", "rec"),
)
def t5_confidence(spark, d):
    return upserted(history.confidence_counts(_records(spark, d)), ["confidence"], every=2)


@query("t6_runs_per_day", twin("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM runs GROUP BY 1", "runs"))
def t6(spark, d):
    runs = stream(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"))
    return drain(aggregates.runs_per_day(runs), "complete").withColumn("day", F.col("day").cast("string"))


@query(
    "t7_stream_new_files",
    twin(
        """SELECT DISTINCT filename FROM (SELECT 'cam' || l_suppkey || '_' || l_partkey || '.mp4' AS filename FROM lineitem WHERE l_returnflag = 'R')
        WHERE filename NOT IN (SELECT filename FROM lat)""",
        "lat",
    ),
)
def t7(spark, d):
    """Arrivals in four unordered sets of files and batches, so that names come again much later."""
    arrived = base.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(
        F.concat(F.lit("cam"), "l_suppkey", F.lit("_"), "l_partkey", F.lit(".mp4")).alias("filename"),
        "l_orderkey",
    )
    files = arrivals(spark, arrived, "l_orderkey", 4)
    return drain(aggregates.new_files(files, operation_queries.latency(spark, d))).select("filename")


@query(
    "t8_stream_classification",
    twin(
        """SELECT item_id, species AS y_true, CASE WHEN level = 'baja' THEN arb ELSE best END AS y_pred, level, round(d, 6) AS distance FROM casc""",
        "casc",
    ),
)
def t8(spark, d):
    catalogue = base.split2(spark, d)
    wanted = catalogue.where("split = 'query'").select("item_id", "species")
    vectors = (
        stream(spark, d, "embeddings")
        .select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
        .join(wanted, "item_id")
    )
    cents = materialize(centroid.centroids(catalogue))
    out = aggregates.classify_all(vectors, cents, catalogue.where("split = 'gallery'"), CONFIDENT, REJECTED)
    return out.select(
        "item_id", F.col("species").alias("y_true"), "y_pred", "level", F.round("distance", 6).alias("distance")
    )


@query(
    "t9_rejected_leave_stream",
    twin("SELECT video_id, event_id AS frame_idx, species, motion_filtered FROM strm", "strm"),
)
def t9(spark, d):
    rows = _kept(_frames(stream(spark, d, "events")))
    return drain(rows).select("video_id", "frame_idx", "species", "motion_filtered")


@query(
    "t10_live_centroids",
    twin(
        """SELECT species, n, generate_subscripts(c, 1) AS pos, round(unnest(c), 6) AS value FROM means""",
        "means",
    ),
)
def t10(spark, d):
    rows = stream(spark, d, "embeddings").select(
        F.concat(F.lit("sp"), "label").alias("species"), F.col("embedding").alias("vec")
    )
    sums = drain(aggregates.live_class_sums(rows), "complete")
    long = sums.select("species", "n", F.posexplode("total").alias("pos", "x"))
    return long.select(
        "species", "n", (F.col("pos") + 1).cast("bigint").alias("pos"), F.round(F.col("x") / F.col("n"), 6).alias("value")
    )
