"""Mixing sources to target weights: a proportionate-fair schedule of blocks.

A source's documents, in seeded hash order, are cut into blocks of ``BLOCK`` characters.
At a constant rate of one block a slot, shared among the sources that are not used up in proportion to
their weights, a source's k-th block (from 1) begins at some time and is full at another.
It is released in the slot of the one and due by the slot of the other; in each slot the
released block with the earliest deadline goes out. Such a schedule always meets its
deadlines, so every source stays within less than one block of its share at every slot.

Times are exact: weights are taken as the rational numbers they are, with no period to
round them to. A source that is used up leaves its share to the others in the same
proportions: no document is dropped or repeated. The schedule is written by one task that
holds a few numbers a source and computes ``WINDOW`` slots at a time in numpy: floats of extended
precision with a bound on their error, whole numbers where the bound leaves the rounding open.

Running positions inside a source come from chunked running sums, so a source that
holds a third of all rows is spread over many tasks. Texts do not take part; they are
shuffled once, when the caller wants them in the new order.

Nulls and edge cases: a null source is a stream of its own; a null text counts as
empty, every document as one character more than it has; rows that repeat doc_id, text
and source are placed together; a source without a stated weight gets the smallest
stated one; a non-positive weight counts as tiny; an empty table gives an empty schedule.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotline.llm.common import fresh, stored
from shotline.operators import scan

BLOCK = 1 << 16
WINDOW = 1 << 16  # slots computed and handed on together
TEMPER = 0.5
SEED = 29
CHUNK_ROWS = 20_000
LAST = (1 << 63) - 1


def exact(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights."""
    low = min((Fraction(w) for w in weights.values() if w > 0), default=Fraction(1)) / 1_000_000
    ratios = {s: max(Fraction(w), low) for s, w in weights.items()}
    common = math.lcm(*(w.denominator for w in ratios.values()))
    whole = {s: int(w * common) for s, w in ratios.items()}
    shared = math.gcd(*whole.values())
    return {s: w // shared for s, w in whole.items()}


class _Shares:
    """The constant-rate shares: when the first k blocks of a stream are full, as whole slots."""

    def __init__(self, n: list[int], w: list[int]):
        self.n, self.w = n, w
        # time is the blocks handed out at constant rates: gone[j] + rate[j] * share while j streams are used up
        self.last = sorted(range(len(n)), key=lambda i: Fraction(n[i], w[i]))
        self.gone, self.rate = [0], [sum(w)]
        for i in self.last:
            self.gone.append(self.gone[-1] + n[i])
            self.rate.append(self.rate[-1] - w[i])
        total = self.rate[0]
        self.unit = _extended([Fraction(total, x) for x in w])
        self.ends = _extended([Fraction(n[i] * total, w[i]) for i in self.last])
        self.start = _extended([Fraction(x) for x in self.gone[:-1]])
        self.speed = _extended([Fraction(x, total) for x in self.rate[:-1]])

    def exactly(self, i: int, k: int) -> tuple[int, int]:
        """The time at which stream i's first k blocks are full, rounded down and up."""
        low, high = 0, len(self.last) - 1
        while low < high:
            mid = (low + high) // 2
            if self.n[self.last[mid]] * self.w[i] < k * self.w[self.last[mid]]:
                low = mid + 1
            else:
                high = mid
        time = self.rate[low] * k
        return self.gone[low] + time // self.w[i], self.gone[low] - (-time // self.w[i])

    def full(self, i: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``exactly`` for many blocks: in extended floats, and again in whole numbers where these round unsurely."""
        share = k * self.unit[i]
        low = np.minimum(np.searchsorted(self.ends, share), len(self.ends) - 1)
        time = self.start[low] + self.speed[low] * share
        down, up = np.floor(time).astype(np.int64), np.ceil(time).astype(np.int64)
        grain = 64 * np.finfo(time.dtype).eps
        unsure = np.flatnonzero(np.abs(time - np.rint(time)) <= grain * (time + 1))
        before = self.ends[np.maximum(low - 1, 0)]
        edge = (np.abs(self.ends[low] - share) <= grain * share) | (np.abs(before - share) <= grain * share)
        part = (unsure, i[unsure], k[unsure], low[unsure], edge[unsure])
        for at, stream, block, ended, near in zip(*(x.tolist() for x in part)):
            if near:
                down[at], up[at] = self.exactly(stream, block)
            else:
                time_up, rest = divmod(self.rate[ended] * block, self.w[stream])
                down[at] = self.gone[ended] + time_up
                up[at] = down[at] + (rest > 0)
        return down, up


def _extended(values: list[Fraction]) -> np.ndarray:
    high = [float(x) for x in values]
    return np.array(high, np.longdouble) + np.array([float(x - Fraction(h)) for x, h in zip(values, high)], np.longdouble)


def windows(blocks: dict[str, int], weights: dict[str, float], slots: int = WINDOW) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(names, stream number of each slot, its block from 0) for ``slots`` slots at a time.

    The blocks released in a window are computed together; only taking the earliest deadline
    of those at hand goes slot by slot. Held are a few numbers a stream and the blocks of a window.
    """
    names = sorted(s for s, n in blocks.items() if n > 0)
    if not names:
        return
    whole = exact({s: weights[s] for s in names})
    shares = _Shares([blocks[s] for s in names], [whole[s] for s in names])
    n = np.array(shares.n, np.int64)
    total, streams = int(n.sum()), np.arange(len(names))
    known = np.zeros(len(names), np.int64)  # blocks at hand or placed
    release = np.zeros(len(names), np.int64)  # slot of each stream's next block
    done = np.zeros(len(names), np.int64)
    ready: list[int] = []
    for first in range(0, total, slots):
        end = min(first + slots, total)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        more = streams[(known < n) & (release < end)]
        step = np.ones(len(names), np.int64)
        while len(more):  # a few blocks of each stream, twice as many each time
            count = np.minimum(step[more], n[more] - known[more])
            i = np.repeat(more, count)
            nth = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            down, up = shares.full(i, known[i] + nth + 1)
            opened = np.where(nth == 0, release[i], np.roll(down, 1))
            taken = opened < end
            held.append((opened[taken], up[taken] * len(names) + i[taken]))
            kept = np.bincount(i[taken], minlength=len(names))[more]
            at = np.cumsum(count) - count + kept - 1
            release[more] = down[at]
            known[more] += kept
            step[more] *= 2
            more = more[(known[more] < n[more]) & (release[more] < end)]
        opened = np.concatenate([o for o, _ in held]) if held else np.zeros(0, np.int64)
        keys = np.concatenate([d for _, d in held]) if held else opened
        order = np.argsort(opened, kind="stable")
        keys = keys[order].tolist()
        out, at = [], 0
        for upto in np.searchsorted(opened[order], np.arange(first, end), side="right").tolist():
            while at < upto:
                heapq.heappush(ready, keys[at])
                at += 1
            out.append(heapq.heappop(ready))
        stream = np.array(out, np.int64) % len(names)
        by = np.argsort(stream, kind="stable")
        used = np.bincount(stream, minlength=len(names))
        block = np.empty(len(out), np.int64)
        block[by] = np.arange(len(out)) - np.repeat(np.cumsum(used) - used - done, used)
        done += used
        yield names, stream, block


def turns(blocks: dict[str, int], weights: dict[str, float], slots: int = WINDOW) -> Iterator[tuple[str, int]]:
    """(stream, block from 0) for each slot, earliest deadline first."""
    for names, stream, block in windows(blocks, weights, slots):
        yield from zip((names[i] for i in stream.tolist()), block.tolist())


def _turns(weights: dict[str, float] | None, size: int):
    """Slots of all blocks from the streams' totals, which come in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[int, str | None]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                totals[row["stream"]] = (row["total"], row["source"])
        if weights is None:
            target = {s: total**TEMPER for s, (total, _) in totals.items()}
        else:
            least = min(weights.values(), default=1.0)
            target = {s: weights.get(source, least) for s, (_, source) in totals.items()}
        slot = 0
        for names, stream, block in windows({s: -(-total // size) for s, (total, _) in totals.items()}, target):
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()).take(pa.array(stream)), pa.array(block), pa.array(np.arange(slot, slot + len(block)))],
                names=["stream", "block", "slot"],
            )
            slot += len(block)

    return run


def schedule(
    docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK
) -> DataFrame:
    """(oid, tid, source, stream, block, slot, place), one row for each distinct doc_id, text and source.

    ``weights`` maps sources to weights; without it they are the sources' sizes to the
    power ``TEMPER``. Every source has its own weight and stream, however many there are. Read in the
    order of (slot, place), every prefix holds the sources in proportion to the weights of those not used up.
    """
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1
    items = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("oid"),
        F.xxhash64("text").alias("tid"),
        F.col("source"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")).alias("stream"),
        size.alias("size"),
    )
    items = items.groupBy("stream", "source", "oid", "tid").agg(F.sum("size").alias("size"))
    items = stored(items.withColumn("h", F.xxhash64(F.lit(SEED), "oid", "tid")), "mix-items")
    totals = stored(
        items.groupBy("stream").agg(F.sum("size").alias("total"), F.min("source").cast("string").alias("source")), "mix-totals"
    )
    blocks = totals.coalesce(1).mapInArrow(_turns(weights, block), "stream string, block long, slot long")

    # chunks of the hash range, each of about CHUNK_ROWS rows
    bits = max(1, math.ceil(math.log2(max(items.count() / CHUNK_ROWS, 1) + 1)) + 1)
    chunk = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits)
    signed = scan.running(items, ["stream"], ["h", "oid", "tid", "source"], chunk, sums={"upto": F.col("size")})
    cut = stored(signed.withColumn("block", F.floor((F.col("upto") - F.col("size")) / block)), "mix-blocks")
    order = Window.partitionBy("stream", "block").orderBy("h", "oid", "tid", "source")
    placed = cut.withColumn("place", F.row_number().over(order))
    return placed.join(stored(blocks, "mix-slots"), ["stream", "block"]).select(
        "oid", "tid", "source", "stream", "block", "slot", "place"
    )


def report(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, source, block, slot and place of every row."""
    placed = stored(schedule(docs, weights), "mix-schedule")
    rows = docs.select(
        "doc_id", "source", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("oid"), F.xxhash64("text").alias("tid")
    )
    same = (
        (rows["oid"] == placed["oid"]) & (rows["tid"] == placed["tid"]) & rows["source"].eqNullSafe(placed["source"])
    )
    return rows.join(placed, same).select(rows["doc_id"], rows["source"], "stream", "block", "slot", "place")


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs``, all of them, in range partitions sorted by the schedule."""
    placed = stored(schedule(docs, weights), "mix-schedule").select("oid", "tid", "source", "slot", "place")
    oid, tid, src, slot, place = (fresh(docs, c) for c in ("_oid", "_tid", "_source", "_slot", "_place"))
    placed = placed.toDF(oid, tid, src, slot, place)
    rows = docs.withColumns(
        {oid: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), tid: F.xxhash64("text")}
    )
    joined = rows.join(
        placed,
        (rows[oid] == placed[oid]) & (rows[tid] == placed[tid]) & rows["source"].eqNullSafe(placed[src]),
    )
    return joined.repartitionByRange(slot, place).sortWithinPartitions(slot, place).select(
        *[rows[c] for c in docs.columns]
    )
