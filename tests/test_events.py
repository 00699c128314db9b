import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shotline.operators import events, frames

THRESHOLD = 0.5
SCHEMA = (
    "video_id bigint, frame_idx bigint, ts double, species string, dist double, level string, "
    "motion_filtered boolean, top5 array<struct<species string, cosine_distance double>>, area double"
)


def random_frames(videos=250, longest=25, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for v in range(videos):
        for i in range(int(rng.integers(0, longest + 1))):
            filtered = bool(rng.random() < 0.15)
            species = str(rng.choice(["a", "b"], p=[0.75, 0.25]))
            dist = float(round(rng.choice([0.2, 0.3, 0.7]) + rng.integers(0, 3) * 0.01, 2))
            top5 = [{"species": str(rng.choice(["a", "b", "c"])), "cosine_distance": dist}]
            rows.append((v, i, i / 2, species, dist, "baja", filtered, top5, float(rng.integers(0, 5))))
    return rows


class Machine:
    """Literal confirm/close behaviour, one video at a time."""

    def __init__(self, quorum, closing):
        self.quorum, self.closing = quorum, closing
        self.found, self.pending, self.event = [], [], None

    def close(self, frames_, ambiguous):
        hits = [f for f in frames_ if f["dist"] <= THRESHOLD]
        names = [f["species"] for f in hits]
        winner = max(dict.fromkeys(names), key=names.count)
        best = min((f for f in hits if f["species"] == winner), key=lambda f: f["dist"])
        self.found.append(
            (frames_[0]["ts"], hits[-1]["ts"], winner, best["frame_idx"], len(frames_), len(hits), ambiguous)
        )
        self.event, self.pending = None, []

    def feed(self, frame):
        hit = not frame["motion_filtered"] and frame["dist"] <= THRESHOLD
        if self.event is None:
            if not hit:
                self.pending = []
                return
            if self.pending and self.pending[-1]["species"] != frame["species"]:
                self.pending = []
            self.pending.append(frame)
            if len(self.pending) == self.quorum:
                self.event, self.misses = self.pending, 0
            return
        if not frame["motion_filtered"]:
            self.event.append(frame)
        self.misses = 0 if hit else self.misses + 1
        if self.misses == self.closing:
            self.close(self.event, False)

    def finish(self):
        if self.event is not None:
            self.close(self.event, False)
        elif self.pending:
            self.close(self.pending, True)
        return self.found


def expected(rows, quorum, closing):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    out = {}
    by_video = {}
    for row in rows:
        frame = dict(zip(["video_id", "frame_idx", "ts", "species", "dist", "level", "motion_filtered", "top5", "area"], row))
        by_video.setdefault(frame["video_id"], Machine(quorum, closing)).feed(frame)
    for video, machine in by_video.items():
        for e in machine.finish():
            out[(video, *e)] = out.get((video, *e), 0) + 1
    return out


def result(df):
    cols = ["video_id", "start_time", "end_time", "species", "representative_frame_idx", "n_frames", "n_hits", "ambiguous"]
    out = {}
    for r in df.select(*cols).collect():
        out[tuple(r)] = out.get(tuple(r), 0) + 1
    return out


@pytest.mark.parametrize("quorum,closing,span", [(1, 1, 3), (2, 1, 4), (2, 2, 1), (2, 3, 3), (3, 2, 5), (4, 4, 2), (3, 2, 1000)])
def test_sliding_events_equal_the_state_machine(spark, quorum, closing, span):
    rows = random_frames(seed=quorum * 10 + closing)
    members = events.sliding_members(spark.createDataFrame(rows, SCHEMA), quorum, closing, THRESHOLD, span)
    assert result(events.sliding_events(members)) == expected(rows, quorum, closing)


def test_stream_steps_equal_the_state_machine():
    from shotline.streaming.events import detector_finish, detector_step

    for quorum in (1, 2, 3):
        for closing in (1, 2, 3):
            rows = random_frames(400, seed=quorum * 7 + closing)
            got, own, last = {}, {}, None
            found = []
            for row in [*rows, (None,) * 9]:
                if row[0] != last and last is not None:
                    found += [(last, e) for e in detector_finish(own)]
                    own = {}
                last = row[0]
                if last is not None:
                    frame = dict(frame_idx=row[1], ts=row[2], species=row[3], dist=row[4], level=row[5], motion_filtered=row[6])
                    found += [(last, e) for e in detector_step(own, frame, quorum, closing, THRESHOLD)]
            for v, e in found:
                key = (v, e["start_time"], e["end_time"], e["species"], e["representative_frame_idx"], e["n_frames"], e["n_hits"], e["ambiguous"])
                got[key] = got.get(key, 0) + 1
            assert got == expected(rows, quorum, closing)


@pytest.mark.parametrize("span", [4, 1000])
def test_static_windows_equal_a_plain_loop(spark, span):
    rows = [r for r in random_frames(60, seed=9) if not r[6]]
    out = events.static_windows(spark.createDataFrame(rows, SCHEMA), 5, 3, span).collect()
    by_video = {}
    for r in rows:
        by_video.setdefault(r[0], []).append(r)
    want = {}
    for v, fr in by_video.items():
        for n, i in enumerate(range(0, len(fr), 5)):
            w = fr[i : i + 5]
            names = [f[3] for f in w]
            winner = max(dict.fromkeys(names), key=names.count)
            ambiguous = names.count(winner) < 3
            best = min((f for f in w if ambiguous or f[3] == winner), key=lambda f: f[4])
            top = best[7]
            if all(c["species"] != winner for c in top):
                offered = [c["cosine_distance"] for f in w if f[3] == winner for c in f[7] if c["species"] == winner]
                top = [{"species": winner, "cosine_distance": min(offered, default=best[4])}] + top
            want[(v, n)] = (winner, w[0][2], w[-1][2], best[1], ambiguous, [f[4] for f in w], [(c["species"], c["cosine_distance"]) for c in top])
    got = {
        (r["video_id"], r["window_no"]): (
            r["species"], r["start_time"], r["end_time"], r["representative_frame_idx"], r["ambiguous"], r["frame_distances"],
            [(c["species"], c["cosine_distance"]) for c in r["top5_candidates"]],
        )
        for r in out
    }
    assert got == want


@pytest.mark.parametrize("large", [2, 10_000])
def test_interval_counts_equal_pairwise_counting(spark, large):
    rng = np.random.default_rng(4)
    points = [(int(v), float(t) / 2, bool(m)) for v, t, m in zip(rng.integers(0, 3, 300), rng.integers(0, 80, 300), rng.random(300) < 0.4)]
    spans = [(int(v), i, float(a) / 2, float(a + w) / 2) for i, (v, a, w) in enumerate(zip(rng.integers(0, 4, 60), rng.integers(0, 80, 60), rng.integers(0, 30, 60)))]
    out = events.with_counts(
        spark.createDataFrame(spans, "video_id bigint, event bigint, start_time double, end_time double"),
        spark.createDataFrame(points, "video_id bigint, ts double, motion_filtered boolean"),
        "event",
        large,
    ).collect()
    assert len(out) == len(spans)
    for r in out:
        inside = [m for v, t, m in points if v == r["video_id"] and r["start_time"] <= t <= r["end_time"]]
        assert (r["motion_filtered_frames"], r["rejected_frames"]) == (sum(inside), len(inside) - sum(inside))


def test_motion_islands_group_neighbouring_samples(spark):
    rows = [(1, i, i / 2, a) for i, a in ((0, 5.0), (3, 9.0), (6, 9.0), (12, 1.0), (18, 2.0), (21, 1.0))]
    out = events.motion_islands(spark.createDataFrame(rows, "video_id bigint, frame_idx bigint, ts double, area double"), 3, span=5)
    got = {(r["start_time"], r["end_time"], r["representative_frame_idx"], r["motion_filtered_frames"]) for r in out.collect()}
    assert got == {(0.0, 3.0, 3, 3), (6.0, 6.0, 12, 1), (9.0, 10.5, 18, 2)}


def test_motion_gate_modes(spark):
    rows = [(v, i, float(i), 300.0 if v == 1 else 50.0, 30.0 if v == 1 else 200.0) for v in (1, 2) for i in range(80)]
    rows += [(3, i, float(i), 0.0, 0.0) for i in range(20)]
    table = spark.createDataFrame(rows, "video_id bigint, frame_idx bigint, ts double, area double, luminance double")
    modes = frames.gates(table, "adaptive", 2, span=7)
    got = {r["video_id"]: (r["effective_mode"], r["min_area"]) for r in modes.collect()}
    assert got == {1: ("adaptive_low_contrast", 100), 2: ("adaptive_high_contrast", 500), 3: ("none", None)}
    kept = frames.motion_gate(table, modes, 2, warmup=10, span=7).groupBy("video_id").agg(F.count_if("motion_filtered").alias("n"))
    assert {r["video_id"]: r["n"] for r in kept.collect()} == {1: 0, 2: 35, 3: 0}
    none = frames.gates(table, "none", 1)
    assert {r["effective_mode"] for r in none.collect()} == {"none"}


def test_classified_frame_wins_over_filtered(spark):
    a = spark.createDataFrame([(1, 0, 0.0, "x")], "video_id int, frame_idx int, ts double, species string")
    b = spark.createDataFrame([(1, 0, 0.0), (1, 1, 1.0)], "video_id int, frame_idx int, ts double")
    got = sorted((r["frame_idx"], r["species"], r["motion_filtered"]) for r in events.interleave(a, b).collect())
    assert got == [(0, "x", False), (1, None, True)]
