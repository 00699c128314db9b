"""Streaming twins of the batch events: confirm/close detector and count windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from shotline.streaming.ordered import replay

EVENT_SCHEMA = (
    "video_id bigint, species string, start_time double, end_time double, "
    "representative_frame_idx bigint, representative_timestamp double, cosine_distance double, "
    "confidence_level string, ambiguous boolean, n_frames bigint, n_hits bigint"
)


def _vote(own: dict, frame: dict) -> None:
    """Count a hit; what is kept grows with the species of an event, not its frames."""
    tally = own["votes"].setdefault(frame["species"], {"n": 0, "first": own["n_frames"], "best": None})
    tally["n"] += 1
    if tally["best"] is None or frame["dist"] < tally["best"]["dist"]:
        tally["best"] = {k: frame[k] for k in ("frame_idx", "ts", "dist", "level")}


def _open(own: dict, frame: dict) -> None:
    own.update(votes={}, n_frames=0, n_hits=0, start=frame["ts"], end=frame["ts"], misses=0, run=0)


def _member(own: dict, frame: dict, hit: bool) -> None:
    if hit:
        _vote(own, frame)
        own["n_hits"] += 1
        own["end"] = frame["ts"]
    own["n_frames"] += 1


def _emit(own: dict, ambiguous: bool) -> dict:
    species, tally = max(own["votes"].items(), key=lambda v: (v[1]["n"], -v[1]["first"]))
    best = tally["best"]
    row = {
        "species": species,
        "start_time": own["start"],
        "end_time": own["end"],
        "representative_frame_idx": best["frame_idx"],
        "representative_timestamp": best["ts"],
        "cosine_distance": best["dist"],
        "confidence_level": best["level"],
        "ambiguous": ambiguous,
        "n_frames": own["n_frames"],
        "n_hits": own["n_hits"],
    }
    own.clear()
    return row


def detector_step(own: dict, frame: dict, quorum: int, closing: int, threshold: float) -> list[dict]:
    """Advance one video by one frame; ``own`` is empty while nothing is pending."""
    filtered = bool(frame["motion_filtered"])
    hit = not filtered and frame["dist"] is not None and frame["dist"] <= threshold
    if not own.get("active"):
        if not hit:
            own.clear()
            return []
        if not own or own["species"] != frame["species"]:
            own.clear()
            _open(own, frame)
            own["species"] = frame["species"]
        _member(own, frame, True)
        own["run"] += 1
        own["active"] = own["run"] >= quorum
        return []
    if not filtered:
        _member(own, frame, hit)
    own["misses"] = 0 if hit else own["misses"] + 1
    return [_emit(own, False)] if own["misses"] >= closing else []


def detector_finish(own: dict) -> list[dict]:
    return [_emit(own, not own.get("active"))] if own else []


OPEN = ["active", "species", "start", "end", "misses", "run", "n_frames", "n_hits"]
BEST = ["frame_idx", "ts", "dist", "level"]


@dataclass
class Detector:
    """The event detector as a machine: the pending event is one value, its votes a map by species."""

    quorum: int
    closing: int
    threshold: float

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.event = handle.getValueState(
            "event",
            "active boolean, species string, start double, end double, misses bigint, run bigint, n_frames bigint, n_hits bigint",
        )
        self.votes = handle.getMapState(
            "votes", "species string", "n bigint, first bigint, frame_idx bigint, ts double, dist double, level string"
        )

    def read(self) -> dict:
        self.kept = {}
        event = self.event.get()
        self.held = event is not None
        if not self.held:
            return {}
        own = dict(zip(OPEN, event))
        self.kept = {k[0]: tuple(v) for k, v in self.votes.iterator()}
        own["votes"] = {k: {"n": n, "first": first, "best": dict(zip(BEST, best))} for k, (n, first, *best) in self.kept.items()}
        return own

    def write(self, own: dict) -> None:
        if not own:
            if self.held:
                self.event.clear()
                self.votes.clear()
            return
        self.event.update(tuple(own.get(name) for name in OPEN))
        now = {k: (v["n"], v["first"], *(v["best"][name] for name in BEST)) for k, v in own["votes"].items()}
        for species in self.kept.keys() - now.keys():
            self.votes.removeKey((species,))
        for species, value in now.items():
            if self.kept.get(species) != value:
                self.votes.updateValue((species,), value)

    def step(self, own: dict, frame: dict) -> list[dict]:
        return detector_step(own, frame, self.quorum, self.closing, self.threshold)

    def finish(self, own: dict) -> list[dict]:
        return detector_finish(own)


def detect_events(
    frames: DataFrame,
    quorum: int,
    closing: int,
    threshold: float,
    delay: str = "10 minutes",
    gap_ms: int = 60_000,
) -> DataFrame:
    """Confirm/close events of a frame stream; rejected frames must be filtered out before."""
    return replay(frames, Detector(quorum, closing, threshold), EVENT_SCHEMA, delay, gap_ms)


WINDOW_SCHEMA = (
    "video_id bigint, window_no bigint, species string, start_time double, end_time double, "
    "representative_frame_idx bigint, cosine_distance double, ambiguous boolean, n_frames bigint"
)


def _close_window(own: dict, quorum: int) -> dict:
    rows = own["rows"]
    votes: dict[str, int] = {}
    for r in rows:
        votes[r["species"]] = votes.get(r["species"], 0) + 1
    winner = max(votes, key=votes.get)
    ambiguous = votes[winner] < quorum
    best = min((r for r in rows if ambiguous or r["species"] == winner), key=lambda r: r["dist"])
    closed = {
        "window_no": own.get("number", 0),
        "species": winner,
        "start_time": rows[0]["ts"],
        "end_time": rows[-1]["ts"],
        "representative_frame_idx": best["frame_idx"],
        "cosine_distance": best["dist"],
        "ambiguous": ambiguous,
        "n_frames": len(rows),
    }
    own["number"] = closed["window_no"] + 1
    own["rows"] = []
    return closed


def window_step(own: dict, frame: dict, window: int, quorum: int) -> list[dict]:
    if frame["motion_filtered"]:
        return []
    own.setdefault("rows", []).append({k: frame[k] for k in ("frame_idx", "ts", "species", "dist")})
    return [_close_window(own, quorum)] if len(own["rows"]) == window else []


MEMBER = ["frame_idx", "ts", "species", "dist"]


@dataclass
class Windows:
    """Count windows as a machine: the open window is a list of at most ``window`` frames, its number a value."""

    window: int
    quorum: int

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.number = handle.getValueState("number", "number bigint")
        self.rows = handle.getListState("rows", "frame_idx bigint, ts double, species string, dist double")

    def read(self) -> dict:
        number = self.number.get()
        self.held = number is not None
        return {"number": number[0] if self.held else 0, "rows": [dict(zip(MEMBER, r)) for r in self.rows.get()] if self.held else []}

    def write(self, own: dict) -> None:
        if not own:
            if self.held:
                self.number.clear()
                self.rows.clear()
            return
        self.number.update((own["number"],))
        rows = [tuple(r[name] for name in MEMBER) for r in own["rows"]]
        if rows:
            self.rows.put(rows)
        else:
            self.rows.clear()

    def step(self, own: dict, frame: dict) -> list[dict]:
        return window_step(own, frame, self.window, self.quorum)

    def finish(self, own: dict) -> list[dict]:
        return [_close_window(own, self.quorum)] if own.get("rows") else []


def window_events(
    frames: DataFrame, window: int, quorum: int, delay: str = "10 minutes", gap_ms: int = 60_000
) -> DataFrame:
    """Tumbling windows of ``window`` accepted frames of a stream."""
    return replay(frames, Windows(window, quorum), WINDOW_SCHEMA, delay, gap_ms)
