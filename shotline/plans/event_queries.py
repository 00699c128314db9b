"""Frame selection and event construction on the ``events`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotline.operators import events, frames, scan
from shotline.plans import base
from shotline.plans.base import cte, query, twin

THRESHOLD, REJECT = 113, 147
WINDOW, QUORUM, CLOSING = 5, 2, 2
EVERY, WARMUP = 2, 20
TYPES = ["click", "error", "purchase", "signup", "view"]


def all_frames(spark, d):
    """Every event is one frame of its user's video."""
    raw = base.table(spark, d, "events").select(
        F.col("user_id").alias("video_id"),
        "event_id",
        F.col("event_type").alias("species"),
        F.col("value").alias("dist"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    numbered = scan.numbered(raw, ["video_id"], "event_id", frames.SPAN, "_n")
    index = F.col("_n") - 1
    other = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("k") % 5 + 1).cast("int"))
    third = F.element_at(F.array(*[F.lit(t) for t in TYPES]), ((F.col("k") + 2) % 5 + 1).cast("int"))
    pair = lambda s, gap: F.struct(s.alias("species"), (F.col("dist") + gap).alias("cosine_distance"))
    return numbered.select(
        "video_id",
        "event_id",
        index.alias("frame_idx"),
        (index / 4.0).alias("ts"),
        "species",
        "dist",
        F.when(F.col("dist") <= 30, "alta").when(F.col("dist") >= REJECT, "rechazado").otherwise("baja").alias("level"),
        F.array(pair(other, 0.0), pair(third, 1.0)).alias("top5"),
        (F.col("k") * 10.0).alias("area"),
        F.col("k").cast("double").alias("luminance"),
        (F.col("k") < 10).alias("motion_filtered"),
    )


_types = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
cte(
    "fr",
    f"""SELECT video_id, event_id, frame_idx, frame_idx / 4.0::DOUBLE AS ts, species, dist, CASE WHEN dist <= 30 THEN 'alta' WHEN dist >= {REJECT} THEN 'rechazado' ELSE 'baja' END AS level,
    {_types}[k % 5 + 1] AS c1, {_types}[(k + 2) % 5 + 1] AS c2, k * 10.0::DOUBLE AS area, k::DOUBLE AS luminance, k < 10 AS motion_filtered
    FROM (SELECT user_id AS video_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_idx, event_type AS species,
      value AS dist, json_extract_string(props, '$.k')::INT AS k FROM events)""",
)
# rejected frames leave before any consensus
cte("acc", "SELECT * FROM fr WHERE NOT motion_filtered AND level <> 'rechazado'", "fr")
cte("strm", "SELECT * FROM fr WHERE motion_filtered OR level <> 'rechazado'", "fr")


def accepted(spark, d):
    return all_frames(spark, d).where("NOT motion_filtered AND level <> 'rechazado'")


def stream_rows(spark, d):
    return all_frames(spark, d).where("motion_filtered OR level <> 'rechazado'")


@query("w9_subsample", twin(f"SELECT video_id, frame_idx, ts, species, dist FROM fr WHERE frame_idx % 3 = 0", "fr"))
def w9(spark, d):
    return frames.subsample(all_frames(spark, d), 3).select("video_id", "frame_idx", "ts", "species", "dist")


cte("tot", "SELECT video_id, max(frame_idx) + 1 AS total FROM fr GROUP BY video_id", "fr")
cte(
    "light",
    """SELECT video_id, total, avg(luminance) AS mean_luminance, CASE WHEN avg(luminance) < 60 THEN 'low_contrast' ELSE 'high_contrast' END AS lighting
    FROM (SELECT video_id, total, luminance, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS rn FROM fr JOIN tot USING (video_id)
      WHERE frame_idx % greatest(1, total // 20) = 0) WHERE rn <= 10 GROUP BY video_id, total""",
    "fr",
    "tot",
)
cte(
    "gate",
    f"""SELECT video_id, greatest(1, ceil(total / {EVERY}.0::DOUBLE))::BIGINT AS n_sampled,
    CASE WHEN ceil(total / {EVERY}.0::DOUBLE) < 30 THEN 'none' ELSE 'adaptive_' || lighting END AS effective_mode,
    CASE WHEN ceil(total / {EVERY}.0::DOUBLE) < 30 THEN NULL WHEN lighting = 'high_contrast' THEN 500 ELSE 100 END AS min_area FROM light""",
    "light",
)


@query(
    "w11_lighting",
    twin("SELECT video_id, total, round(mean_luminance, 6) AS mean_luminance, lighting FROM light", "light"),
)
def w11(spark, d):
    out = frames.lighting(all_frames(spark, d))
    return out.withColumn("mean_luminance", F.round("mean_luminance", 6))


@query("w12_gate_mode", twin("SELECT video_id, n_sampled, effective_mode, min_area FROM gate", "gate"))
def w12(spark, d):
    return frames.gates(all_frames(spark, d), "adaptive", EVERY).drop("total")


@query(
    "w10_motion_gate",
    twin(
        f"""SELECT video_id, frame_idx, area, CASE WHEN min_area IS NULL OR frame_idx < {WARMUP} THEN false ELSE area < min_area END AS motion_filtered
        FROM fr JOIN gate USING (video_id) WHERE frame_idx % {EVERY} = 0""",
        "fr",
        "gate",
    ),
)
def w10(spark, d):
    rows = all_frames(spark, d)
    gated = frames.motion_gate(rows, frames.gates(rows, "adaptive", EVERY), EVERY, WARMUP)
    return gated.select("video_id", "frame_idx", "area", "motion_filtered")


cte(
    "win",
    f"""SELECT *, (row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1) // {WINDOW} AS window_no FROM acc""",
    "acc",
)
cte(
    "wtop",
    f"""SELECT video_id, window_no, arg_min(species, struct_pack(v := -votes, f := first)) AS winner, max(votes) < {QUORUM + 1} AS ambiguous FROM (
      SELECT video_id, window_no, species, count(*) AS votes, min(frame_idx) AS first FROM win GROUP BY ALL) GROUP BY ALL""",
    "win",
)
cte(
    "wev",
    """SELECT video_id, window_no, any_value(winner) AS species, min(ts) AS start_time, max(ts) AS end_time,
    arg_min(frame_idx, struct_pack(d := dist, i := frame_idx)) FILTER (ambiguous OR species = winner) AS representative_frame_idx,
    any_value(ambiguous) AS ambiguous, count(*) AS n_frames, array_to_string(list(round(dist, 2) ORDER BY frame_idx), ',') AS distances,
    min(CASE WHEN species = winner AND c1 = winner THEN dist WHEN species = winner AND c2 = winner THEN dist + 1 END) AS offered
    FROM win JOIN wtop USING (video_id, window_no) GROUP BY video_id, window_no""",
    "win",
    "wtop",
)
cte(
    "wfull",
    """SELECT w.video_id, window_no, w.species, start_time, end_time, representative_frame_idx, f.ts AS representative_timestamp, f.dist AS cosine_distance,
    f.level AS confidence_level, ambiguous, n_frames, distances,
    CASE WHEN f.c1 = w.species OR f.c2 = w.species THEN '' ELSE w.species || ':' || printf('%.2f', coalesce(offered, f.dist)) || ',' END
      || f.c1 || ':' || printf('%.2f', f.dist) || ',' || f.c2 || ':' || printf('%.2f', f.dist + 1) AS candidates
    FROM wev w JOIN fr f ON f.video_id = w.video_id AND f.frame_idx = w.representative_frame_idx""",
    "wev",
    "fr",
)


def _candidates(column):
    return F.array_join(
        F.transform(column, lambda c: F.format_string("%s:%.2f", c["species"], c["cosine_distance"])), ","
    )


@query("w13_static_windows", twin("SELECT * EXCLUDE (candidates) FROM wfull", "wfull"))
def w13(spark, d):
    out = events.static_windows(accepted(spark, d), WINDOW, QUORUM + 1)
    return out.select(
        "video_id",
        "window_no",
        "species",
        "start_time",
        "end_time",
        "representative_frame_idx",
        "representative_timestamp",
        "cosine_distance",
        "confidence_level",
        "ambiguous",
        F.size("frame_distances").alias("n_frames"),
        F.array_join(F.transform("frame_distances", lambda x: F.round(x, 2).cast("string")), ",").alias("distances"),
    )


@query("w14_candidate_repair", twin("SELECT video_id, window_no, species, candidates FROM wfull", "wfull"))
def w14(spark, d):
    out = events.static_windows(accepted(spark, d), WINDOW, QUORUM + 1)
    return out.select("video_id", "window_no", "species", _candidates("top5_candidates").alias("candidates"))


# the same algebra with plain windows over a video
cte(
    "s1",
    f"""SELECT *, NOT motion_filtered AND dist <= {THRESHOLD} AS hit, row_number() OVER v AS rn FROM strm WINDOW v AS (PARTITION BY video_id ORDER BY frame_idx)""",
    "strm",
)
cte(
    "s2",
    """SELECT *, rn - coalesce(max(CASE WHEN hit THEN rn END) OVER v, 0) AS miss_run,
    CASE WHEN hit AND NOT coalesce(lag(hit) OVER w AND lag(species) OVER w = species, false) THEN rn END AS begins
    FROM s1 WINDOW v AS (PARTITION BY video_id ORDER BY rn ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY video_id ORDER BY rn)""",
    "s1",
)
cte(
    "s3",
    f"""SELECT *, coalesce(sum(CASE WHEN miss_run = {CLOSING} THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seg,
    CASE WHEN hit THEN rn - max(begins) OVER (PARTITION BY video_id ORDER BY rn ROWS UNBOUNDED PRECEDING) + 1 ELSE 0 END AS hit_run FROM s2""",
    "s2",
)
cte(
    "opened",
    f"SELECT video_id, seg, min(rn) - {QUORUM - 1} AS start_rn, false AS ambiguous FROM s3 WHERE hit_run = {QUORUM} GROUP BY video_id, seg",
    "s3",
)
cte(
    "spans",
    """SELECT * FROM opened UNION ALL SELECT t.video_id, t.seg, t.rn - t.hit_run + 1, true FROM s3 t JOIN (SELECT video_id, max(rn) AS rn FROM s3 GROUP BY 1) l
    ON l.video_id = t.video_id AND l.rn = t.rn WHERE t.hit AND NOT EXISTS (SELECT 1 FROM opened o WHERE o.video_id = t.video_id AND o.seg = t.seg)""",
    "opened",
)
cte(
    "memb",
    "SELECT s3.*, start_rn, ambiguous FROM s3 JOIN spans USING (video_id, seg) WHERE rn >= start_rn AND NOT motion_filtered",
    "spans",
)
cte(
    "swin",
    """SELECT video_id, start_rn, arg_min(species, struct_pack(v := -votes, f := first)) AS winner FROM (
      SELECT video_id, start_rn, species, count(*) AS votes, min(rn) AS first FROM memb WHERE hit GROUP BY ALL) GROUP BY ALL""",
    "memb",
)
cte(
    "sev2",
    """SELECT video_id, start_rn, any_value(winner) AS species, min(ts) AS start_time, max(ts) FILTER (hit) AS end_time,
    arg_min(frame_idx, struct_pack(d := dist, r := rn)) FILTER (hit AND species = winner) AS representative_frame_idx,
    any_value(ambiguous) AS ambiguous, count(*) AS n_frames, count(*) FILTER (hit) AS n_hits FROM memb JOIN swin USING (video_id, start_rn) GROUP BY video_id, start_rn""",
    "memb",
    "swin",
)
cte(
    "sfull",
    """SELECT e.*, f.ts AS representative_timestamp, f.dist AS cosine_distance, f.level AS confidence_level,
    CASE WHEN f.c1 = e.species OR f.c2 = e.species THEN '' ELSE e.species || ':' || printf('%.2f', f.dist) || ',' END
      || f.c1 || ':' || printf('%.2f', f.dist) || ',' || f.c2 || ':' || printf('%.2f', f.dist + 1) AS candidates
    FROM sev2 e JOIN fr f ON f.video_id = e.video_id AND f.frame_idx = e.representative_frame_idx""",
    "sev2",
    "fr",
)


def members(spark, d, span=frames.SPAN):
    return events.sliding_members(stream_rows(spark, d), QUORUM, CLOSING, THRESHOLD, span)


@query("w15_sliding_members", twin("SELECT video_id, start_rn, frame_idx, ts, dist, hit, ambiguous FROM memb", "memb"))
def w15(spark, d):
    return members(spark, d).select("video_id", "start_rn", "frame_idx", "ts", "dist", "hit", "ambiguous")


@query(
    "w15_sliding_members_chunked",
    twin("SELECT video_id, start_rn, count(*) AS n_frames, ambiguous FROM memb GROUP BY ALL", "memb"),
)
def w15_chunked(spark, d):
    """Videos cut into chunks of eight frames, so that events cross chunk borders."""
    return members(spark, d, 8).groupBy("video_id", "start_rn", "ambiguous").agg(F.count(F.lit(1)).alias("n_frames"))


@query("w16_sliding_events", twin("SELECT * FROM sfull", "sfull"))
def w16(spark, d):
    out = events.sliding_events(members(spark, d))
    return out.withColumn("candidates", _candidates("top5_candidates")).drop("top5_candidates", "consensus_mode")


@query(
    "w17_interleave",
    twin(
        """SELECT video_id, frame_idx, ts, motion_filtered FROM strm UNION ALL
        SELECT video_id, frame_idx, ts, false FROM fr WHERE NOT motion_filtered AND level = 'rechazado'""",
        "strm",
    ),
)
def w17(spark, d):
    rows = all_frames(spark, d)
    shown = rows.where("NOT motion_filtered").drop("motion_filtered")
    hidden = rows.where("motion_filtered OR level = 'rechazado'").select("video_id", "frame_idx", "ts")
    return events.interleave(shown, hidden).select("video_id", "frame_idx", "ts", "motion_filtered")


cte(
    "isl",
    """SELECT video_id, min(ts) AS start_time, max(ts) AS end_time, arg_min(frame_idx, struct_pack(a := -area, i := frame_idx)) AS representative_frame_idx,
    count(*) AS motion_filtered_frames FROM (SELECT *, frame_idx - row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS g FROM fr WHERE motion_filtered) GROUP BY video_id, g""",
    "fr",
)


def islands(spark, d):
    return events.motion_islands(all_frames(spark, d).where("motion_filtered"), 1)


@query("w18_motion_islands", twin("SELECT * FROM isl", "isl"))
def w18(spark, d):
    return islands(spark, d).select(
        "video_id", "start_time", "end_time", "representative_frame_idx", "motion_filtered_frames"
    )


cte(
    "counted",
    """SELECT e.video_id, e.start_rn, e.species, e.start_time, e.end_time, e.ambiguous,
    (SELECT count(*) FROM fr f WHERE f.video_id = e.video_id AND NOT f.motion_filtered AND f.level = 'rechazado' AND f.ts BETWEEN e.start_time AND e.end_time) AS rejected_frames,
    (SELECT count(*) FROM fr f WHERE f.video_id = e.video_id AND f.motion_filtered AND f.ts BETWEEN e.start_time AND e.end_time) AS motion_filtered_frames FROM sev2 e""",
    "sev2",
    "fr",
)


def counted(spark, d):
    found = events.sliding_events(members(spark, d))
    points = all_frames(spark, d).where("motion_filtered OR level = 'rechazado'")
    return events.with_counts(found, points, "start_rn")


@query("j7_interval_counts", twin("SELECT * FROM counted", "counted"))
def j7(spark, d):
    return counted(spark, d).select(
        "video_id", "start_rn", "species", "start_time", "end_time", "ambiguous", "rejected_frames", "motion_filtered_frames"
    )


@query(
    "j7_one_video",
    twin(
        """SELECT e.video_id * 1000000 + e.start_rn AS event,
        (SELECT count(*) FROM fr f WHERE NOT f.motion_filtered AND f.level = 'rechazado' AND f.ts BETWEEN e.start_time AND e.end_time) AS rejected_frames,
        (SELECT count(*) FROM fr f WHERE f.motion_filtered AND f.ts BETWEEN e.start_time AND e.end_time) AS motion_filtered_frames FROM sev2 e""",
        "sev2",
        "fr",
    ),
)
def j7_one(spark, d):
    """The frames of all videos as those of a single one, cut at sampled times."""
    event = (F.col("video_id") * 1_000_000 + F.col("start_rn")).alias("event")
    one = F.lit(0).cast("bigint").alias("video_id")
    found = events.sliding_events(members(spark, d)).select(one, event, "start_time", "end_time")
    points = all_frames(spark, d).where("motion_filtered OR level = 'rechazado'").select(one, "ts", "motion_filtered")
    return events.with_counts(found, points, "event", large=1_000).select("event", "rejected_frames", "motion_filtered_frames")


@query(
    "w19_merged_events",
    twin(
        """SELECT video_id, start_time, end_time, species, 'sliding' AS consensus_mode, rejected_frames, motion_filtered_frames FROM counted
        UNION ALL SELECT video_id, start_time, end_time, '', 'mog2', 0, motion_filtered_frames FROM isl""",
        "counted",
        "isl",
    ),
)
def w19(spark, d):
    return events.merged(counted(spark, d), islands(spark, d)).select(
        "video_id", "start_time", "end_time", "species", "consensus_mode", "rejected_frames", "motion_filtered_frames"
    )


@query(
    "p31_distance_timeline",
    twin(
        """SELECT video_id, start_rn, ts, dist, CASE WHEN dist < 40 THEN 'cerca' WHEN dist < 80 THEN 'media' ELSE 'lejos' END AS band FROM memb""",
        "memb",
    ),
)
def p31(spark, d):
    from shotline.functions.labels import distance_band

    rows = events.timeline(members(spark, d))
    return rows.select("video_id", "start_rn", "ts", "dist", distance_band(F.col("dist"), 40, 80).alias("band"))


@query(
    "p31_window_timeline",
    twin("SELECT video_id, window_no, ts, dist FROM win", "win"),
)
def p31_windows(spark, d):
    out = events.static_windows(accepted(spark, d), WINDOW, QUORUM + 1)
    zipped = F.arrays_zip(F.col("frame_timestamps").alias("ts"), F.col("frame_distances").alias("dist"))
    return out.select("video_id", "window_no", F.inline(zipped))


@query(
    "p28_presets",
    twin(
        """SELECT mode, every, "window", quorum, count(*) AS n_frames FROM fr, (VALUES ('Básico', 60, 5, 3), ('Estándar', 30, 10, 6), ('Profundo', 10, 15, 9)) p(mode, every, "window", quorum)
        WHERE frame_idx % every = 0 GROUP BY ALL""",
        "fr",
    ),
)
def p28(spark, d):
    """Frames each preset would keep."""
    rows = all_frames(spark, d).select("frame_idx")
    names = F.array(
        *[
            F.struct(F.lit(m).alias("mode"), F.lit(n).alias("every"), F.lit(k).alias("window"), F.lit(q).alias("quorum"))
            for m, (n, k, q) in frames.PRESETS.items()
        ]
    )
    kept = rows.select("frame_idx", F.inline(names)).where(F.col("frame_idx") % F.col("every") == 0)
    return kept.groupBy("mode", "every", "window", "quorum").agg(F.count(F.lit(1)).alias("n_frames"))
