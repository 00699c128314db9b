import datetime as dt

import numpy as np
import pytest

from shotline.operators import centroid, events
from shotline.streaming import aggregates
from shotline.streaming.drain import drain, late_rows, newest, start
from shotline.streaming.events import detect_events, window_events
from tests.test_events import SCHEMA, THRESHOLD, random_frames, result

START = dt.datetime(2024, 1, 1)
STREAM = (
    "video_id bigint, frame_idx bigint, ts double, event_time timestamp, species string, dist double, "
    "level string, motion_filtered boolean"
)


def timed(rows):
    return [(*r[:3], START + dt.timedelta(seconds=r[2]), *r[3:7]) for r in rows]


def feed(spark, folder, batches):
    """Write each batch as one file, in order; the last one only moves the watermark on."""
    far = (-1, 0, 0.0, START + dt.timedelta(days=2), "a", 0.0, "alta", False)
    for i, batch in enumerate([*batches, [far]]):
        spark.createDataFrame(batch, STREAM).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/*")


def test_detector_on_shuffled_batches_equals_batch(spark, tmp_path):
    rows = random_frames(40, seed=21)
    order = np.random.default_rng(1).permutation(len(rows))
    batches = [timed([rows[i] for i in part]) for part in np.array_split(order, 3)]
    stream = feed(spark, str(tmp_path / "in"), batches)
    got = result(drain(detect_events(stream, 2, 2, THRESHOLD, delay="1 hour", gap_ms=1000)))
    members = events.sliding_members(spark.createDataFrame(rows, SCHEMA), 2, 2, THRESHOLD)
    assert got == result(events.sliding_events(members))


def test_late_frames_are_dropped_not_replayed(spark, tmp_path):
    frame = lambda i, d: (7, i, float(i), START + dt.timedelta(seconds=i), "a", d, "alta", False)
    marker = lambda s: (8, 0, 0.0, START + dt.timedelta(seconds=s), "a", 0.9, "alta", False)
    batches = [[frame(i, 0.1) for i in (0, 1, 2)], [marker(7200)], [marker(7250)], [frame(3, 0.1)], [marker(7300)]]
    stream = feed(spark, str(tmp_path / "in"), batches)
    folder = f"{tmp_path}/out"
    found = detect_events(stream, 2, 2, THRESHOLD, delay="10 seconds", gap_ms=1000)
    query = start(found, folder, "append")
    query.awaitTermination()
    out = spark.read.schema(found.schema).parquet(f"{folder}/data/*").where("video_id = 7").collect()
    assert [(r["n_frames"], r["ambiguous"]) for r in out] == [(3, False)]
    assert late_rows(query) == 1


def test_a_delay_too_short_for_the_disorder_counts_what_it_loses(spark, tmp_path):
    """Every frame is in an event or counted as late; the engine drops behind the watermark of the batch before."""
    at = lambda i: (i % 3, i, float(i), START + dt.timedelta(seconds=i), "a", 0.1, "alta", False)
    batches = [[at(i) for i in range(60, 90)], [at(i) for i in range(0, 30)], [at(i) for i in range(90, 120)], [at(i) for i in range(30, 60)]]
    stream = feed(spark, str(tmp_path / "in"), batches)
    found = detect_events(stream, 2, 2, THRESHOLD, delay="20 seconds", gap_ms=1000)
    query = start(found, f"{tmp_path}/out", "append")
    query.awaitTermination()
    kept = spark.read.schema(found.schema).parquet(f"{tmp_path}/out/data/*").where("video_id >= 0")
    late = late_rows(query)
    assert late == 30 and sum(r["n_frames"] for r in kept.collect()) == 120 - late


def test_state_survives_a_restart(spark, tmp_path):
    """A query that ends and starts again from its checkpoint goes on with the waiting frames and votes."""
    rows = random_frames(12, seed=4)
    order = np.random.default_rng(2).permutation(len(rows))
    halves = [timed([rows[i] for i in part]) for part in np.array_split(order, 2)]
    far = (-1, 0, 0.0, START + dt.timedelta(days=2), "a", 0.0, "alta", False)
    folder = f"{tmp_path}/out"
    for i, batch in enumerate([*halves, [far]]):
        spark.createDataFrame(batch, STREAM).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
        stream = spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        found = detect_events(stream, 2, 2, THRESHOLD, delay="1 hour", gap_ms=1000)
        start(found, folder, "append").awaitTermination()
    got = result(spark.read.schema(found.schema).parquet(f"{folder}/data/*"))
    members = events.sliding_members(spark.createDataFrame(rows, SCHEMA), 2, 2, THRESHOLD)
    assert got == result(events.sliding_events(members))


def test_windows_on_a_stream_equal_batch(spark, tmp_path):
    rows = [r for r in random_frames(25, seed=5) if not r[6]]
    stream = feed(spark, str(tmp_path / "in"), [timed(rows[::2]), timed(rows[1::2])])
    keep = ["video_id", "window_no", "species", "start_time", "end_time", "representative_frame_idx", "ambiguous"]
    got = drain(window_events(stream, 5, 3, delay="1 hour", gap_ms=1000)).select(*keep)
    want = events.static_windows(spark.createDataFrame(rows, SCHEMA), 5, 3).select(*keep)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_each_new_file_passes_once(spark, tmp_path):
    """Names that come again in the same batch, in the next one, and long after any delay."""
    schema = "filename string, ts timestamp"
    later = START + dt.timedelta(days=40)
    for i, (names, at) in enumerate(((["a", "b", "b"], START), (["b", "c", "a"], START), (["c", "b", "d"], later), (["d", "b"], START))):
        spark.createDataFrame([(n, at) for n in names], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    known = spark.createDataFrame([("a",)], "filename string")
    assert sorted(r["filename"] for r in drain(aggregates.new_files(stream, known)).collect()) == ["b", "c", "d"]


def test_live_class_sums_equal_batch(spark, tmp_path):
    rows = [(f"s{i % 3}", [float(i), float(i * i % 7), 1.0]) for i in range(40)]
    schema = "species string, vec array<double>"
    for i in range(4):
        spark.createDataFrame(rows[i::4], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = {r["species"]: r for r in drain(aggregates.live_class_sums(stream), "complete").collect()}
    want = {r["species"]: r for r in centroid.class_sums(centroid.normalised(spark.createDataFrame(rows, schema))).collect()}
    for s in want:
        assert got[s]["n"] == want[s]["n"] and got[s]["total"] == pytest.approx(want[s]["total"])


@pytest.mark.parametrize("every", [2, 3, 50])
def test_upsert_keeps_the_newest_row_of_each_key(spark, tmp_path, every):
    """Over seven batches, with bases in between, a batch stored twice, and a restart."""
    rng = np.random.default_rng(6)
    words = [str(w) for w in rng.choice(list("abcdefgh"), 70)]
    folder, schema = f"{tmp_path}/out", "word string"
    for i in range(7):
        spark.createDataFrame([(w,) for w in words[i * 10 : i * 10 + 10]], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        if i in (3, 6):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
            counts = stream.groupBy("word").count()
            start(counts, folder, "update", ["word"], every).awaitTermination()
    want = {w: words.count(w) for w in set(words)}
    read = lambda: {r["word"]: r["count"] for r in newest(spark, folder, ["word"], counts.schema).collect()}
    assert read() == want
    last = spark.read.parquet(f"{folder}/data/batch=6").collect()
    spark.createDataFrame(last, counts.schema).write.mode("overwrite").parquet(f"{folder}/data/batch=6")
    assert read() == want
    kept = sorted(int(p.name.partition("=")[2]) for p in (tmp_path / "out/data").iterdir())
    assert kept[-1] == 6 and len(kept) <= 2 * every


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_streams_as_a_file_and_as_a_folder(spark, tmp_path, files):
    """Other tables beside it, also those whose names begin alike, stay out."""
    from pathlib import Path

    from shotline.plans.stream_queries import stream

    spark.range(30).repartition(files).write.parquet(f"{tmp_path}/made")
    if files == 1:
        next(Path(tmp_path, "made").glob("*.parquet")).rename(tmp_path / "events.parquet")
    else:
        Path(tmp_path, "made").rename(tmp_path / "events.parquet")
    spark.range(100, 200).write.parquet(f"{tmp_path}/events.parquet2")
    spark.range(200, 300).write.parquet(f"{tmp_path}/orders.parquet")
    got = drain(stream(spark, str(tmp_path), "events")).collect()
    assert sorted(r["id"] for r in got) == list(range(30))


@pytest.mark.parametrize("files", [1, 6])
def test_batches_follow_the_sets_not_their_files(spark, tmp_path, files):
    from shotline.plans.stream_queries import arrivals

    rows = spark.range(0, 400, 1, files)
    stream = arrivals(spark, rows, "id", 3, spark.range(1000, 1001, 1, 1))
    query = start(stream, f"{tmp_path}/out", "append")
    query.awaitTermination()
    sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert sum(sizes) == 401 and len(sizes) == 4


def test_frames_wait_as_one_entry_a_batch(spark, tmp_path):
    """Frames that are not due yet are kept in columns; values that are missing or no number stay missing."""
    at = lambda i, d, m: (1, i, float(i), START + dt.timedelta(seconds=i), "a", d, None, m)
    batches = [[at(3, 0.1, False), at(1, 0.1, False)], [at(0, None, None), at(2, float("nan"), True), at(4, 0.1, False)]]
    stream = feed(spark, str(tmp_path / "in"), batches)
    found = drain(detect_events(stream, 2, 2, THRESHOLD, delay="1 hour", gap_ms=1000)).where("video_id = 1").collect()
    assert [(r["n_frames"], r["n_hits"], r["confidence_level"]) for r in found] == [(2, 2, None)]


def test_frames_without_a_video_stay_apart(spark, tmp_path):
    """They follow each other like those of one video and take no frames from videos of their batch."""
    rows = random_frames(3, seed=8)
    videos = sorted({r[0] for r in rows})
    nameless = [(None, *r[1:]) if r[0] == videos[0] else tuple(r) for r in rows]
    stream = feed(spark, str(tmp_path / "in"), [timed(nameless[::2]), timed(nameless[1::2])])
    got = drain(detect_events(stream, 2, 2, THRESHOLD, delay="1 hour", gap_ms=1000)).collect()
    members = events.sliding_members(spark.createDataFrame(rows, SCHEMA), 2, 2, THRESHOLD)
    want = events.sliding_events(members).collect()
    pick = lambda r, own: (own, r["species"], r["representative_frame_idx"], r["ambiguous"], r["n_frames"], r["n_hits"])
    named = lambda v: None if v == videos[0] else v
    key = lambda r: tuple(map(str, r))
    assert sorted((pick(r, r["video_id"]) for r in got), key=key) == sorted((pick(r, named(r["video_id"])) for r in want), key=key)
