"""Events from ordered frames: count windows, confirm/close events, motion islands.

Frames carry video_id, frame_idx, ts, species, dist, level and, where needed,
top5 (array of species and cosine_distance) and motion_filtered. Rejected frames
are removed before; they neither confirm nor close an event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotline.operators.frames import SPAN, chunk_of
from shotline.operators.scan import LARGE, running, sampled_chunks
from shotline.session import materialize


def interleave(classified: DataFrame, filtered: DataFrame) -> DataFrame:
    """One stream of classified and motion-filtered frames; classified wins on equal index."""
    both = classified.withColumn("motion_filtered", F.lit(False)).unionByName(
        filtered.withColumn("motion_filtered", F.lit(True)), allowMissingColumns=True
    )
    others = [c for c in both.columns if c not in ("video_id", "frame_idx")]
    pick = F.min_by(F.struct(*others), F.col("motion_filtered").cast("int"))
    return both.groupBy("video_id", "frame_idx").agg(pick.alias("_r")).select("video_id", "frame_idx", "_r.*")


# --- count windows -------------------------------------------------------------------


def static_windows(frames: DataFrame, window: int, quorum: int, span: int = SPAN) -> DataFrame:
    """Tumbling windows of ``window`` accepted frames; the last one may be short.

    The most frequent species wins, the first seen on ties; below the quorum the
    event is ambiguous and represented by the nearest frame of any species.
    """
    numbered = running(
        frames, ["video_id"], ["frame_idx"], chunk_of(span=span), sums={"_rn": F.lit(1)}
    )
    windows = numbered.withColumn("window_no", F.floor((F.col("_rn") - 1) / F.lit(window)))
    row = F.struct("frame_idx", "ts", "species", "dist", "level", "top5")
    # a group never holds more than ``window`` frames
    grouped = windows.groupBy("video_id", "window_no").agg(
        F.array_sort(F.collect_list(row)).alias("f")
    )
    return _decide(grouped, quorum)


def _decide(grouped: DataFrame, quorum: int) -> DataFrame:
    """Winner, representative and candidates of each group ``f`` of ordered frames."""
    seen = F.array_distinct(F.transform("f", lambda x: x["species"]))
    votes = F.transform(
        seen,
        lambda s, i: F.struct(
            F.size(F.filter("f", lambda x: x["species"] == s)).alias("votes"),
            (-i).alias("place"),
            s.alias("species"),
        ),
    )
    voted = grouped.withColumn("top", F.array_max(votes)).withColumn(
        "ambiguous", F.col("top")["votes"] < quorum
    )
    winner = F.col("top")["species"]
    mine = F.filter("f", lambda x: x["species"] == winner)
    pool = F.when(F.col("ambiguous"), F.col("f")).otherwise(mine)
    nearest = F.array_min(
        F.transform(pool, lambda x: F.struct(x["dist"].alias("d"), x["frame_idx"].alias("i")))
    )
    chosen = voted.withColumn("near", nearest)
    best = F.element_at(F.filter("f", lambda x: x["frame_idx"] == F.col("near")["i"]), 1)
    chosen = chosen.withColumn("best", best)
    # the winner's own candidate distances in the window, nearest first
    offered = F.flatten(
        F.transform(
            F.filter("f", lambda x: x["species"] == winner),
            lambda x: F.filter(x["top5"], lambda c: c["species"] == winner),
        )
    )
    least = F.array_min(F.transform(offered, lambda c: c["cosine_distance"]))
    return chosen.select(
        "video_id",
        "window_no",
        winner.alias("species"),
        F.element_at("f", 1)["ts"].alias("start_time"),
        F.element_at("f", -1)["ts"].alias("end_time"),
        F.col("best")["frame_idx"].alias("representative_frame_idx"),
        F.col("best")["ts"].alias("representative_timestamp"),
        F.col("best")["dist"].alias("cosine_distance"),
        F.col("best")["level"].alias("confidence_level"),
        "ambiguous",
        with_winner(F.col("best")["top5"], winner, F.coalesce(least, F.col("best")["dist"])).alias(
            "top5_candidates"
        ),
        F.lit("static").alias("consensus_mode"),
        F.transform("f", lambda x: x["dist"]).alias("frame_distances"),
        F.transform("f", lambda x: x["ts"]).alias("frame_timestamps"),
    )


def with_winner(top5: Column, winner: Column, distance: Column) -> Column:
    """Put the winner in front of the candidates when it is not among them."""
    head = F.array(F.struct(winner.alias("species"), distance.alias("cosine_distance")))
    return F.when(F.exists(top5, lambda c: c["species"] == winner), top5).otherwise(
        F.concat(head, top5)
    )


# --- confirm / close events -----------------------------------------------------------


def annotate(frames: DataFrame, closing: int, threshold: float, span: int = SPAN) -> DataFrame:
    """Number frames, split videos at closings, and count runs of agreeing hits.

    Adds ``hit``, ``rn`` (position), ``seg`` (closings strictly before the frame)
    and ``hit_run`` (length of the current run of hits of one species). Every
    column is first computed inside a chunk of the video; what a chunk needs to
    know about the ones before it is worked out on one summary row per chunk.
    """
    hit = ~F.col("motion_filtered") & (F.col("dist") <= threshold)
    rows = frames.withColumn("hit", F.coalesce(hit, F.lit(False))).withColumn(
        "_chunk", chunk_of(span=span)
    )
    order = Window.partitionBy("video_id", "_chunk").orderBy("frame_idx")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_n", F.row_number().over(order))
    local = local.withColumn("_hit_at", F.max(F.when(F.col("hit"), F.col("_n"))).over(upto))
    lead = F.col("_hit_at").isNull()
    crossing = ~lead & (F.col("_n") - F.col("_hit_at") == closing)
    same = F.coalesce(F.lag("hit").over(order), F.lit(False)) & F.coalesce(
        F.lag("species").over(order) == F.col("species"), F.lit(False)
    )
    begins = F.when(F.col("hit") & ~same, F.col("_n"))
    local = (
        local.withColumn("_cross", crossing.cast("bigint"))
        .withColumn("_crossed", F.sum(crossing.cast("bigint")).over(upto))
        .withColumn("_begins", begins)
        .withColumn("_run_at", F.max("_begins").over(upto))
    )

    summary = local.groupBy("video_id", "_chunk").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("_hit_at").alias("hit_at"),
        F.sum("_cross").alias("cross"),
        F.count_if(lead).alias("lead"),
        F.min_by(F.struct("hit", "species"), "_n").alias("first"),
        F.max_by(F.struct("hit", "species", F.col("_run_at").alias("run_at")), "_n").alias("last"),
    )
    by_chunk = Window.partitionBy("video_id").orderBy("_chunk")
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    last_hit = F.max(F.col("_before") + F.col("hit_at")).over(before)
    carry = carry.withColumn("_misses", F.col("_before") - F.coalesce(last_hit, F.lit(0)))
    # the misses that open a chunk may complete a closing begun in earlier chunks
    lead_cross = (F.col("_misses") < closing) & (F.col("_misses") + F.col("lead") >= closing)
    carry = carry.withColumn("_lead_cross", lead_cross)
    total_cross = F.col("cross") + F.col("_lead_cross").cast("bigint")
    prior = F.lag("last").over(by_chunk)
    continues = F.coalesce(
        prior["hit"] & F.col("first")["hit"] & (prior["species"] == F.col("first")["species"]), F.lit(False)
    )
    carry = carry.withColumn("_closings", F.coalesce(F.sum(total_cross).over(before), F.lit(0)))
    carry = carry.withColumn("_continues", continues)
    whole = F.col("_continues") & (F.col("last")["run_at"] == 1)
    run_start = F.when(F.col("last")["hit"] & ~whole, F.col("_before") + F.col("last")["run_at"])
    carry = carry.withColumn("_run_start", F.last(run_start, ignorenulls=True).over(before))
    carry = carry.select(
        "video_id", "_chunk", "_before", "_misses", "_lead_cross", "_closings", "_continues", "_run_start"
    )

    joined = local.join(carry, ["video_id", "_chunk"])
    lead_done = F.col("_lead_cross") & (F.col("_n") >= closing - F.col("_misses"))
    miss_run = (
        F.when(F.col("hit"), 0)
        .when(lead, F.col("_misses") + F.col("_n"))
        .otherwise(F.col("_n") - F.col("_hit_at"))
    )
    rn = F.col("_before") + F.col("_n")
    seg = (
        F.col("_closings")
        + F.col("_crossed")
        + lead_done.cast("bigint")
        - (miss_run == closing).cast("bigint")
    )
    carried = F.col("hit") & F.col("_continues") & (F.col("_run_at") == 1)
    hit_run = (
        F.when(carried, rn - F.col("_run_start") + 1)
        .when(F.col("hit"), F.col("_n") - F.col("_run_at") + 1)
        .otherwise(0)
    )
    return joined.select(
        *frames.columns, "hit", rn.alias("rn"), seg.alias("seg"), hit_run.alias("hit_run")
    )


def sliding_members(
    frames: DataFrame, quorum: int, closing: int, threshold: float, span: int = SPAN
) -> DataFrame:
    """Frames of every confirm/close event, with ``start_rn`` and ``ambiguous``.

    An event opens with ``quorum`` consecutive hits of one species and ends with
    its ``closing``-th consecutive miss or with the video. A run of hits still
    short of the quorum when the video ends becomes an ambiguous event.
    Motion-filtered frames count as misses but are no members.
    """
    rows = materialize(annotate(frames, closing, threshold, span))
    opens = F.min(F.when(F.col("hit_run") == quorum, F.col("rn"))) - (quorum - 1)
    segments = rows.groupBy("video_id", "seg").agg(opens.alias("start_rn"), F.max("rn").alias("end_rn"))
    opened = segments.where(F.col("start_rn").isNotNull())
    ends = rows.groupBy("video_id").agg(
        F.max_by(F.struct("rn", "hit", "seg", "hit_run"), "rn").alias("e")
    )
    tails = (
        ends.where(F.col("e")["hit"])
        .select(
            "video_id",
            F.col("e")["seg"].alias("seg"),
            (F.col("e")["rn"] - F.col("e")["hit_run"] + 1).alias("start_rn"),
            F.col("e")["rn"].alias("end_rn"),
        )
        .join(opened, ["video_id", "seg"], "left_anti")
    )
    spans = opened.withColumn("ambiguous", F.lit(False)).unionByName(
        tails.withColumn("ambiguous", F.lit(True))
    )
    # a long event meets its frames chunk by chunk, not as one join key
    part = lambda c: F.floor(F.col(c) / F.lit(span))
    spread = spans.select(
        "video_id", "seg", "start_rn", "ambiguous", F.explode(F.sequence(part("start_rn"), part("end_rn"))).alias("_part")
    )
    return (
        rows.withColumn("_part", part("rn"))
        .join(spread, ["video_id", "seg", "_part"])
        .where((F.col("rn") >= F.col("start_rn")) & ~F.col("motion_filtered"))
        .drop("_part")
    )


def sliding_events(members: DataFrame) -> DataFrame:
    """One row per confirm/close event from its member frames.

    Winner and representative come from hits only; the event starts with its first
    member and ends with the last hit. Frame values stay in ``members`` (see
    ``timeline``), since an event has no length limit.
    """
    event = ["video_id", "seg", "start_rn", "ambiguous"]
    low = F.col("hit")
    has_top5 = ["top5"] if "top5" in members.columns else []
    frame = F.struct("frame_idx", "ts", "dist", "level", *has_top5)
    per_species = members.groupBy(*event, "species").agg(
        F.count_if(low).alias("votes"),
        F.min(F.when(low, F.col("rn"))).alias("first"),
        F.min_by(F.when(low, frame), F.when(low, F.struct("dist", "rn"))).alias("best"),
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("rn", "ts")).alias("begin"),
        F.max(F.when(low, F.struct("rn", "ts"))).alias("finish"),
    )
    whole = per_species.groupBy(*event).agg(
        F.max_by(F.struct("species", "best"), F.struct("votes", -F.col("first"))).alias("w"),
        F.min("begin").alias("begin"),
        F.max("finish").alias("finish"),
        F.sum("n").alias("n_frames"),
        F.sum("votes").alias("n_hits"),
    )
    best = F.col("w")["best"]
    out = whole.select(
        "video_id",
        "start_rn",
        F.col("w")["species"].alias("species"),
        F.col("begin")["ts"].alias("start_time"),
        F.col("finish")["ts"].alias("end_time"),
        best["frame_idx"].alias("representative_frame_idx"),
        best["ts"].alias("representative_timestamp"),
        best["dist"].alias("cosine_distance"),
        best["level"].alias("confidence_level"),
        "ambiguous",
        F.lit("sliding").alias("consensus_mode"),
        "n_frames",
        "n_hits",
        *([with_winner(best["top5"], F.col("w")["species"], best["dist"]).alias("top5_candidates")] if has_top5 else []),
    )
    return out


def timeline(members: DataFrame) -> DataFrame:
    """Distance of each member frame, in long form."""
    return members.select("video_id", "start_rn", "frame_idx", "ts", "dist")


# --- motion islands, interval counts, merging -------------------------------------------


def motion_islands(filtered: DataFrame, every: int, span: int = SPAN) -> DataFrame:
    """Groups of motion-filtered frames that follow each other in the sampled order."""
    numbered = running(
        filtered, ["video_id"], ["frame_idx"], chunk_of(span=span), sums={"_rn": F.lit(1)}
    )
    keyed = numbered.withColumn("_island", F.col("frame_idx") - F.lit(every) * F.col("_rn"))
    rep = F.max_by(F.struct("frame_idx", "ts"), F.struct("area", -F.col("frame_idx")))
    return (
        keyed.groupBy("video_id", "_island")
        .agg(
            F.min("ts").alias("start_time"),
            F.max("ts").alias("end_time"),
            rep.alias("rep"),
            F.count(F.lit(1)).alias("motion_filtered_frames"),
        )
        .select(
            "video_id",
            F.lit("").alias("species"),
            "start_time",
            "end_time",
            F.col("rep")["frame_idx"].alias("representative_frame_idx"),
            F.col("rep")["ts"].alias("representative_timestamp"),
            F.lit(0.0).alias("cosine_distance"),
            F.lit("mog2").alias("confidence_level"),
            F.lit(False).alias("ambiguous"),
            F.lit("mog2").alias("consensus_mode"),
            F.lit(0).cast("bigint").alias("rejected_frames"),
            "motion_filtered_frames",
            F.lit("Filtro MOG2").alias("decisor"),
        )
    )


def count_inside(
    events: DataFrame, points: DataFrame, key: str, counts: dict[str, Column], large: int = LARGE
) -> DataFrame:
    """How many points fall into each event's closed interval, by kind.

    The count inside an interval is the running count at its end minus the running
    count before its start, so points and interval bounds are sorted together
    once; no point is paired with an interval. A video of more than ``large`` rows is
    cut at sampled times, so that one long video is many tasks. Result: video_id, key, one
    column per entry of ``counts``.
    """
    none = {n: F.lit(0).alias(n) for n in counts}
    key_type = events.schema[key].dataType
    marks = events.select(
        "video_id",
        key,
        F.inline(
            F.array(
                F.struct(F.col("start_time").alias("ts"), F.lit(0).alias("_place")),
                F.struct(F.col("end_time").alias("ts"), F.lit(2).alias("_place")),
            )
        ),
    ).select("video_id", key, "ts", "_place", *none.values())
    spots = points.select(
        "video_id",
        F.lit(None).cast(key_type).alias(key),
        "ts",
        F.lit(1).alias("_place"),
        *[c.cast("int").alias(n) for n, c in counts.items()],
    )
    both, chunk = sampled_chunks(marks.unionByName(spots), ["video_id"], "ts", large)
    swept = running(
        both, ["video_id"], ["ts", "_place"], chunk, sums={f"_{n}": F.col(n) for n in counts}
    ).where(F.col("_place") != 1)
    sign = F.when(F.col("_place") == 2, 1).otherwise(-1)
    return swept.groupBy("video_id", key).agg(*[F.sum(sign * F.col(f"_{n}")).alias(n) for n in counts])


def with_counts(events: DataFrame, points: DataFrame, key: str, large: int = LARGE) -> DataFrame:
    """Add rejected_frames and motion_filtered_frames; points carry motion_filtered."""
    counts = count_inside(
        events,
        points,
        key,
        {
            "rejected_frames": ~F.col("motion_filtered"),
            "motion_filtered_frames": F.col("motion_filtered"),
        },
        large,
    )
    return events.join(counts, ["video_id", key])


def merged(events: DataFrame, islands: DataFrame) -> DataFrame:
    """Both kinds of events in chronological order inside each video."""
    return events.unionByName(islands, allowMissingColumns=True).orderBy("video_id", "start_time")
