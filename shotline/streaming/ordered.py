"""Per-video state over frames replayed in order.

Frames may arrive late or out of order. They wait in the state of their video until the
watermark has passed them and are then replayed by frame_idx; rows behind the watermark are
dropped by the engine and counted in its progress (``drain.late_rows``). A video is
flushed when no frame has come for ``gap`` of event time.

The state is typed and kept in the state store: waiting frames are a list with one entry of
columns for each batch, only appended to while none of them is due, a clock holds the newest time,
the earliest waiting one and the timer that is set, and the machine keeps its own variables. Every
call of the store is a message to another process, so none is made whose answer is known. Timers wake a
video when a frame or its flush is due. Queries need the RocksDB state store (``drain.start`` sets it).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

FRAME = ["frame_idx", "ts", "species", "dist", "level", "motion_filtered"]
WAITING = (
    "due array<bigint>, frame_idx array<bigint>, ts array<double>, species array<string>, dist array<double>, "
    "level array<string>, motion_filtered array<boolean>"
)
UNDATED = -(2**63)  # a frame without a time is due at once


class Machine(Protocol):
    """What is done with a video's frames; ``own`` is the machine's state in memory."""

    def init(self, handle: StatefulProcessorHandle) -> None: ...

    def read(self) -> dict: ...

    def write(self, own: dict) -> None: ...

    def step(self, own: dict, frame: dict) -> list[dict]: ...

    def finish(self, own: dict) -> list[dict]: ...


class Replay(StatefulProcessor):
    def __init__(self, machine: Machine, names: list[str], gap_ms: int):
        self.machine, self.names, self.gap_ms = machine, names, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.clock = handle.getValueState("clock", "newest bigint, due bigint, timer bigint")
        self.machine.init(handle)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        # not-a-number counts as missing
        new = [tuple(None if v != v else v for v in (r["_due"], *(r[name] for name in FRAME))) for r in rows]
        newest, first, timer = self.clock.get() or (0, None, None)
        newest = max([newest, *(r[0] for r in new)])
        first = min([r[0] for r in new] + ([] if first is None else [first]), default=None)
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), newest, first, timer, new)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: Any) -> Iterator[Row]:
        clock = self.clock.get()
        if clock is not None:
            yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), *clock, [])

    def _advance(
        self, key: Any, mark: int, newest: int, first: int | None, timer: int | None, new: list[tuple]
    ) -> Iterator[Row]:
        out: list[dict] = []
        own = None
        if first is not None and first <= mark:
            before = list(self.waiting.get())
            rows = [row for columns in before for row in zip(*columns)] + new
            rest = [r for r in rows if r[0] > mark]
            own = self.machine.read()
            for _, *values in sorted((r for r in rows if r[0] <= mark), key=lambda r: r[1]):
                out += self.machine.step(own, dict(zip(FRAME, values)))
            first = min((r[0] for r in rest), default=None)
            if rest:
                self.waiting.put([_columns(rest)])
            elif before:
                self.waiting.clear()
        elif new:
            self.waiting.appendList([_columns(new)])
        over = first is None and mark > newest + self.gap_ms
        if over:
            own = self.machine.read() if own is None else own
            out += self.machine.finish(own)
            own = {}
            wake = None
            self.clock.clear()
        else:
            wake = newest + self.gap_ms + 1 if first is None else first
            self.clock.update((newest, first, wake))
        if own is not None:
            self.machine.write(own)
        if wake != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wake is not None:
                self.handle.registerTimer(wake)
        for row in out:
            yield Row(**{name: key[0] if name == "video_id" else row[name] for name in self.names})

    def close(self) -> None:
        pass


def _columns(rows: list[tuple]) -> tuple:
    return tuple(list(column) for column in zip(*rows))


def replay(frames: DataFrame, machine: Machine, schema: str, delay: str, gap_ms: int) -> DataFrame:
    """Run ``machine`` over the ordered frames of each video_id of a stream.

    ``frames`` has video_id, event_time (timestamp) and the columns in FRAME;
    ``schema`` describes the rows returned, beginning with video_id.
    """
    names = [part.split()[0] for part in schema.split(",")]
    dated = frames.withWatermark("event_time", delay).select(
        "video_id", "event_time", F.coalesce(F.unix_millis("event_time"), F.lit(UNDATED)).alias("_due"), *FRAME
    )
    return dated.groupBy("video_id").transformWithState(Replay(machine, names, gap_ms), schema, "append", "eventTime")
