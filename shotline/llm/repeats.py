"""Windows of a fixed length that occur twice or more in a corpus: the steps two operators share.

A text is a row of symbols (bytes or words). The anchor of a window is the smallest
hash among its runs of ``gram`` symbols (winnowing), so equal windows have equal anchors
at equal places. Consecutive windows with one anchor form a stretch; every window of
a text lies in exactly one.

1. ``stretches``: one narrow row per stretch: hash of the anchor, hash of the stretch.
2. An anchor hash that occurs once ends there: its windows are unique.
3. Equal stretches of the other anchors are one kind. The symbols of a kind are fetched once from
   a text and brought together by anchor; a kind that occurs again takes part as two
   stretches. A resolver (the operator's method) finds the windows they share.
4. An anchor with more than ``MOST`` different stretches is not gathered: the hashes of its
   windows are counted by Spark instead, window by window.
5. The repeated windows, as ranges of symbols, go back to the texts.

Texts and stretches that certainly need not meet others are held back by a ``Sieve`` before each
wide join. These joins carry no hints: a table is broadcast by the session's threshold alone, so that
the disk that shuffles take follows the input.

Texts are named by two hashes (128 bits), so null and repeated ids need no care and
equal texts share their ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotline.llm.common import Sieve, broadcast_small, long_texts, stored, text_bytes, text_slices
from shotline.llm.hashing import mix

MOST = 4_096
#: odd multipliers of the two window hashes, and their inverses modulo 2 ** 64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
STEP = np.uint64(0xA0761D6478BD642F)


class Powers:
    """base ** i and its inverse modulo 2 ** 64, grown as needed."""

    def __init__(self, which: int):
        self.base, self.back = np.uint64(BASES[which]), np.uint64(INVERSES[which])
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            self.up, self.down = (self._powers(b, 2 * n) for b in (self.base, self.back))
        return self.up[: n + 1], self.down[: n + 1]

    @staticmethod
    def _powers(base: np.uint64, n: int) -> np.ndarray:
        factors = np.full(n + 1, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)


class Sums:
    """Hashes of runs of symbols from running sums of their values."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self.down = powers.upto(len(values))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[:-1], dtype=np.uint64)))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[b] - self.sums[a]) * self.down[a]

    def all(self, size: int) -> np.ndarray:
        """The hashes of every run of ``size`` symbols."""
        n = len(self.sums) - size
        with np.errstate(over="ignore"):
            return (self.sums[size:] - self.sums[:n]) * self.down[:n]


@dataclass(frozen=True)
class Unit:
    """What a symbol is: ``split`` gives a text's symbols, ``values`` their 64-bit values.

    ``symbols`` is bytes or a list of words; ``join`` is what a stretch is stored as.
    """

    split: Callable[[bytes], object]
    values: Callable[[object], np.ndarray]
    join: Callable[[object], bytes]


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` neighbours."""
    span = 1
    while span * 2 <= size:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (size - span)], x[size - span :]) if size > span else x


STRETCH = "ah long, ch long, t1 long, t2 long, s0 int, size int, anchor int"


def _stretches(unit: Unit, window: int, gram: int):
    """Rows (anchor hash, stretch hash, text, first symbol, symbols, place of the anchor)."""
    names = [c.split()[0] for c in STRETCH.split(", ")]

    def of(texts: list[bytes | None], t1: np.ndarray, t2: np.ndarray, powers: Powers) -> pa.RecordBatch | None:
        split = [unit.split(t) for t in texts if t]
        rows = np.array([i for i, t in enumerate(texts) if t], np.int64)
        sizes = np.array([len(s) for s in split], np.int64)
        long = sizes >= window
        split, rows, sizes = [s for s, ok in zip(split, long) if ok], rows[long], sizes[long]
        if not len(rows):
            return None
        values = np.concatenate([unit.values(s) for s in split])
        sums, ends = Sums(values, powers), np.cumsum(sizes)
        grams = mix(sums.all(gram))
        bits = np.uint64(max(20, int(len(values)).bit_length()))
        place = np.arange(len(grams), dtype=np.uint64)
        best = sliding_least(((grams >> bits) << bits) | place, window - gram + 1)
        best = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        counts = sizes - window + 1
        start = np.repeat(ends - sizes - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        owner = np.repeat(np.arange(len(rows)), counts)
        anchor = best[start]
        new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))))
        last = np.concatenate((new[1:], [len(start)])) - 1
        a, b, p, o = start[new], start[last] + window, anchor[new], owner[new]
        with np.errstate(over="ignore"):
            whole = mix(sums.of(a, b) + ((b - a).astype(np.uint64) << np.uint64(32)) + (p - a).astype(np.uint64) * STEP)
        begin = (ends - sizes)[o]
        columns = [grams[p].view(np.int64), whole.view(np.int64), t1[rows[o]], t2[rows[o]]]
        columns += [x.astype(np.int32) for x in (a - begin, b - a, p - a)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(0)
        for batch in batches:
            t1, t2, at = batch["t1"].to_numpy(), batch["t2"].to_numpy(), 0
            for texts in text_slices(batch["text"], 1 << 20):
                part = slice(at, at + len(texts))
                at += len(texts)
                made = of(texts, t1[part], t2[part], powers)
                if made is not None:
                    yield made

    return run


FOUND = "ah long, ch long, anchor int, twins int, data binary"


def _fetch(unit: Unit):
    """The symbols of the wanted stretches of each text; a text that comes again in a task is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            rows: list[tuple[int, int, int, int, bytes]] = []
            size = 0
            marked = zip(*(batch[c].to_pylist() for c in ("t1", "t2", "wanted")), text_bytes(batch["text"]))
            for t1, t2, wanted, text in marked:
                if (t1, t2) in seen:
                    continue
                seen.add((t1, t2))
                symbols = unit.split(text)
                for w in wanted:
                    data = unit.join(symbols[w["s0"] : w["s0"] + w["size"]])
                    rows.append((w["ah"], w["ch"], w["anchor"], w["twins"], data))
                    size += len(data)
                if size > 8 << 20:
                    yield _found(rows)
                    rows, size = [], 0
            if rows:
                yield _found(rows)

    return run


def _found(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["ah", "ch", "anchor", "twins", "data"]
    )


RANGES = "ah long, ch long, lo int, hi int"
#: (anchor hashes, places of the anchors, stretches, window) -> repeated window starts of each stretch
Resolver = Callable[[np.ndarray, np.ndarray, list[bytes], int], list[np.ndarray]]


def ranges(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Ranges of symbols covered by windows at the (sorted) starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window) + 1
    return [(int(p[0]), int(p[-1]) + window) for p in np.split(starts, cut)]


def _resolve(resolver: Resolver, window: int, most_bytes: int):
    """Run the resolver on runs of whole anchors of a partition sorted by anchor.

    A kind that occurs again is given twice, so that the resolver decides about it as well;
    what it finds for both is reported once.
    """

    def emit(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
        given = [r for r in rows for _ in range(r[3])]
        ah = np.array([r[0] for r in given], np.int64)
        found = resolver(ah, np.array([r[2] for r in given], np.int64), [r[4] for r in given], window)
        first = np.cumsum([0, *(r[3] for r in rows)])
        out = [(r[0], r[1], lo, hi) for r, i in zip(rows, first) for lo, hi in ranges(found[i], window)]
        a, c, lo, hi = zip(*out) if out else ([], [], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
            names=["ah", "ch", "lo", "hi"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("ah", "ch", "anchor", "twins", "data"))):
                if rows and row[:2] == rows[-1][:2]:
                    continue  # fetched twice
                if rows and row[0] != rows[-1][0] and size >= most_bytes:
                    yield emit(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4]) * row[3]
        if rows:
            yield emit(rows)

    return run


WINDOWS = "w1 long, w2 long, ah long, ch long, at int, twins int"


def _each_window(unit: Unit, window: int):
    """Two hashes of every window of a stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(0), Powers(1)
        for batch in batches:
            for ah, ch, twins, data in zip(*(batch[c].to_pylist() for c in ("ah", "ch", "twins")), text_bytes(batch["data"])):
                values = unit.values(unit.split(data))
                a, b = mix(Sums(values, powers[0]).all(window)), mix(Sums(mix(values), powers[1]).all(window))
                n = len(a)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(a.view(np.int64)),
                        pa.array(b.view(np.int64)),
                        pa.array(np.full(n, ah)),
                        pa.array(np.full(n, ch)),
                        pa.array(np.arange(n, dtype=np.int32)),
                        pa.array(np.full(n, twins, np.int32)),
                    ],
                    names=[c.split()[0] for c in WINDOWS.split(", ")],
                )

    return run


def named(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """Texts with their two hashes."""
    return long_texts(docs).select(
        *columns, F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.col("text")).alias("t2"), "text"
    )


def repeated_ranges(
    docs: DataFrame,
    unit: Unit,
    resolver: Resolver,
    window: int,
    gram: int,
    label: str,
    most: int = MOST,
    most_bytes: int = 1 << 20,
) -> DataFrame:
    """(t1, t2, spans): ranges [lo, hi) of symbols that repeated windows cover, for texts that have some."""
    texts = named(docs)
    every = stored(texts.mapInArrow(_stretches(unit, window, gram), STRETCH), f"{label}-stretches")
    anchors = every.groupBy("ah").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ah")
    anchors = stored(anchors, f"{label}-anchors")
    likely = Sieve(anchors, ["ah"], f"{label}-likely").passing(every)

    kinds = likely.groupBy("ah", "ch").agg(
        F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("twins"),
        F.min(F.struct("t1", "t2", "s0", "size", "anchor")).alias("one"),
    )
    kinds = stored(kinds.select("ah", "ch", "twins", "one.*").join(anchors, "ah"), f"{label}-kinds")
    hot = stored(kinds.groupBy("ah").count().where(F.col("count") > most).select("ah"), f"{label}-hot")
    members = F.collect_list(F.struct("ah", "ch", "s0", "size", "anchor", "twins"))
    by_text = kinds.groupBy("t1", "t2").agg(members.alias("wanted"))
    sources = Sieve(kinds.select("t1", "t2").distinct(), ["t1", "t2"], f"{label}-sources")
    wanted = sources.passing(texts).join(by_text, ["t1", "t2"])
    found = wanted.select("t1", "t2", "wanted", "text").mapInArrow(_fetch(unit), FOUND)
    if hot.isEmpty():
        cold = found
    else:
        found = stored(found.dropDuplicates(["ah", "ch"]), f"{label}-found")
        cold = found.join(broadcast_small(hot), "ah", "left_anti")
    shared = (
        cold.repartition("ah").sortWithinPartitions("ah", "ch").mapInArrow(_resolve(resolver, window, most_bytes), RANGES)
    )
    if not hot.isEmpty():
        windows = stored(
            found.join(broadcast_small(hot), "ah").mapInArrow(_each_window(unit, window), WINDOWS), f"{label}-windows"
        )
        twice = windows.groupBy("w1", "w2").agg(F.sum("twins").alias("n")).where("n > 1").select("w1", "w2")
        counted = windows.join(stored(twice, f"{label}-twice"), ["w1", "w2"])
        shared = shared.union(counted.select("ah", "ch", F.col("at").alias("lo"), (F.col("at") + window).alias("hi")))
    shared = stored(shared, f"{label}-shared")
    again = Sieve(shared, ["ah", "ch"], f"{label}-again").passing(every.select("ah", "ch", "t1", "t2", "s0"))
    marks = again.join(shared, ["ah", "ch"]).select(
        "t1", "t2", (F.col("s0") + F.col("lo")).alias("lo"), (F.col("s0") + F.col("hi")).alias("hi")
    )
    spans = marks.groupBy("t1", "t2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return stored(spans, f"{label}-spans")


def with_spans(docs: DataFrame, spans: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, spans) for every row of ``docs``; texts that certainly have no spans are not shuffled."""
    rows, some = named(docs, "doc_id"), Sieve(spans, ["t1", "t2"], f"{label}-marked")
    joined = some.passing(rows).join(spans, ["t1", "t2"], "left").select("doc_id", "text", "spans")
    none = F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")
    return joined.union(some.failing(rows).select("doc_id", "text", none))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Disjoint, non-adjacent ranges in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out
