"""Line de-duplication by a deletion-neighbourhood join.

A line is removed if an earlier line (by doc_id, then place in the text) is equal, or,
from ``SHORT`` words on, within one word of it (replaced, added or left out). Lines are
compared as their words; a line without a word is never removed and never a partner.

1. Each line gives two hashes of its words; if long enough also hashes of its first and
   of its second half, as they are and one word shorter. Two lines within one edit
   have one of these in common, so a line that shares none with a different line
   needs no neighbourhood.
2. The other lines emit their deletion neighbourhood, on the side that is not shared:
   for each word the hash of the line without it, once as a shorter line and once
   with the place of the gap.
3. Equal hashes meet in an aggregation that keeps the earliest line of each kind. No
   pairs are formed, and a hash that very many lines have is reduced before the
   shuffle. Each line then meets the earliest line of each of its hashes.
4. The edit is verified: equal places of the gap and equal second, independent hashes of
   the words around it (128 bits together) mean an edit distance of at most one word.
   The removed line numbers go back to the texts.

Nulls and edge cases: a null text stays null; a text that loses all lines becomes
empty and its row stays; a null doc_id comes after all others; rows that repeat both
doc_id and text are one document and get one result; kept lines keep their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotline.llm.common import broadcast_small, fresh, long_texts, sliced, stored, text_bytes
from shotline.llm.hashing import mix, xxh64

SHORT = 10  # words from which one edit is allowed
#: odd multipliers of the two hashes, their inverses modulo 2 ** 64, and tags of the kinds
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
LENGTH, GAP, LEFT, RIGHT = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 3, 5))
PIECE = 64_000  # words hashed together
LAST = (1 << 63) - 1  # order of a null doc_id


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


class Runs:
    """Hashes of any run of words of a list, from running sums (two independent ones)."""

    def __init__(self, words: list[bytes]):
        plain = b" ".join(words)
        gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
        ends = np.concatenate((gaps, [len(plain)]))
        h = xxh64(plain, np.concatenate(([0], gaps + 1)), ends, 7) if words else np.zeros(0, np.uint64)
        self.sums, self.power, self.inverse = [], [], []
        with np.errstate(over="ignore"):
            for base, inverse in zip(BASES, INVERSES):
                power = _powers(base, len(h))
                self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[:-1], dtype=np.uint64))))
                self.power.append(power)
                self.inverse.append(_powers(inverse, len(h)))
                h = mix(h + LENGTH)

    def raw(self, which: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[which][b] - self.sums[which][a]) * self.inverse[which][a]

    def whole(self, which: int, a: np.ndarray, b: np.ndarray, tag: np.uint64 = np.uint64(0)) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(self.raw(which, a, b) + (b - a).astype(np.uint64) * LENGTH + tag)

    def without(self, which: int, a: np.ndarray, b: np.ndarray, i: np.ndarray, gap: bool) -> np.ndarray:
        """Hash of words a..b without the i-th; with ``gap`` its place counts too."""
        with np.errstate(over="ignore"):
            value = self.raw(which, a, a + i) + self.raw(which, a + i + 1, b) * self.power[which][i]
            value = value + (b - a - 1).astype(np.uint64) * LENGTH
            return mix(value + (i + 1).astype(np.uint64) * GAP if gap else value)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


LINES = "oid long, tid long, line int, h1 long, h2 long, halves array<long>"


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per line with a word: its document, number, hashes and half hashes."""
    words: list[bytes] = []
    rows: list[tuple[int, int, int, int]] = []

    def emit() -> pa.RecordBatch:
        oid, tid, line, count = (np.array(c, np.int64) for c in zip(*rows))
        runs, b = Runs(words), np.cumsum(count)
        a = b - count
        long, m = count >= SHORT, count // 2
        x, y, z = a[long], b[long], m[long]
        halves = np.stack(
            [
                runs.whole(0, x, x + z, LEFT),
                runs.whole(0, x, x + z - 1, LEFT),
                runs.whole(0, x + z, y, RIGHT),
                runs.whole(0, x + z + 1, y, RIGHT),
            ],
            1,
        ).ravel()
        offsets = np.concatenate(([0], np.cumsum(np.where(long, 4, 0)))).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(oid),
                pa.array(tid),
                pa.array(line.astype(np.int32)),
                _signed(runs.whole(0, a, b)),
                _signed(runs.whole(1, a, b)),
                pa.ListArray.from_arrays(pa.array(offsets), _signed(halves)),
            ],
            names=[c.split()[0] for c in LINES.split(", ")],
        )

    for batch in batches:
        for oid, tid, text in zip(batch["oid"].to_pylist(), batch["tid"].to_pylist(), text_bytes(batch["text"])):
            for number, line in enumerate((text or b"").split(b"\n")):
                if found := line.split():
                    words += found
                    rows.append((oid, tid, number, len(found)))
            if len(words) >= PIECE:
                yield emit()
                words, rows = [], []
    if rows:
        yield emit()


VARIANTS = "key long, check long, kind int, oid long, tid long, line int"


def _variant_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The deletion neighbourhoods of the marked lines; a batch emits equal lines once, as the earliest."""
    for batch in batches:
        first: dict[bytes, tuple[tuple[int, int, int], int]] = {}
        marked = zip(*(batch[c].to_pylist() for c in ("oid", "tid", "lines")), text_bytes(batch["text"]))
        for oid, tid, lines, text in marked:
            split = (text or b"").split(b"\n")
            for mark in lines:
                number, sides = mark["line"], mark["sides"]
                key = b" ".join(split[number].split())
                order, known = first.get(key, ((oid, tid, number), 0))
                first[key] = (min(order, (oid, tid, number)), known | sides)
        items = list(first.items())
        at = 0
        while at < len(items):
            words, part, size = [], [], 0
            while at < len(items) and size < PIECE // 4:
                found = items[at][0].split()
                words += found
                part.append((*items[at][1][0], len(found), items[at][1][1]))
                size += len(found)
                at += 1
            oid, tid, line, count, sides = (np.array(c, np.int64) for c in zip(*part))
            runs, b = Runs(words), np.cumsum(count)
            a, m = b - count, count // 2
            # left half shared: the edit is at or behind it; right half shared: at or before it
            low = np.where(sides & 2, 0, m - 1)
            high = np.where(sides & 1, count, m + 1)
            n = high - low
            row = np.repeat(np.arange(len(part)), n)
            i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[row]
            whole = np.arange(len(part))
            for kind, rows, keys in (
                (0, whole, [runs.whole(k, a, b) for k in (0, 1)]),
                (1, row, [runs.without(k, a[row], b[row], i, False) for k in (0, 1)]),
                (2, row, [runs.without(k, a[row], b[row], i, True) for k in (0, 1)]),
            ):
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(keys[0]),
                        _signed(keys[1]),
                        pa.array(np.full(len(rows), kind, np.int32)),
                        pa.array(oid[rows]),
                        pa.array(tid[rows]),
                        pa.array(line[rows].astype(np.int32)),
                    ],
                    names=[c.split()[0] for c in VARIANTS.split(", ")],
                )


def _keyed(docs: DataFrame) -> DataFrame:
    return long_texts(docs).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("oid"), F.xxhash64("text").alias("tid"), "text"
    )


def _near(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(oid, tid, line) of lines within one word of an earlier one."""
    halves = distinct.select("first", F.posexplode("halves").alias("place", "half"))
    side = F.when(F.col("place") < 2, 1).otherwise(2)
    shared = stored(halves.groupBy("half").count().where("count > 1").select("half"), "halves")
    marked = (
        halves.withColumn("side", side)
        .join(broadcast_small(shared), "half")
        .groupBy("first")
        .agg(F.bit_or("side").alias("sides"))
        .select("first.*", "sides")
    )
    marked = stored(marked, "marked")
    few = marked.count() <= 1_000_000
    by_doc = marked.groupBy("oid", "tid").agg(F.collect_set(F.struct("line", "sides")).alias("lines"))
    keyed = _keyed(docs)
    wanted = keyed.join(F.broadcast(by_doc) if few else by_doc, ["oid", "tid"])
    variants = stored(wanted.select("oid", "tid", "lines", "text").mapInArrow(_variant_rows, VARIANTS), "variants")
    own = F.struct("oid", "tid", "line")
    entry = F.struct("oid", "tid", "line", "check")
    hits = variants.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(F.when(F.col("kind") == k, entry)).alias(f"least{k}") for k in (0, 1, 2)],
    )
    hits = broadcast_small(stored(hits.where("n > 1").drop("n"), "hits"))

    def earlier(k: int) -> Column:
        least = F.col(f"least{k}")
        before = F.struct(*[least[c].alias(c) for c in ("oid", "tid", "line")]) < own
        return F.coalesce(before & (least["check"] == F.col("check")), F.lit(False))

    verified = (
        F.when(F.col("kind") == 0, earlier(0) | earlier(1)).when(F.col("kind") == 1, earlier(0)).otherwise(earlier(2))
    )
    return variants.join(hits, "key").where(verified).select("oid", "tid", "line")


def removed_lines(docs: DataFrame) -> DataFrame:
    """(oid, tid, gone): the numbers of the lines to remove, for each document that has some."""
    lines = stored(_keyed(docs).mapInArrow(_line_rows, LINES), "lines")
    order = F.struct("oid", "tid", "line")
    distinct = stored(
        lines.groupBy("h1", "h2").agg(
            F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.max("halves").alias("halves")
        ),
        "distinct",
    )
    copies = stored(distinct.where("n > 1").select("h1", "h2", "first"), "copies")
    exact = lines.join(broadcast_small(copies), ["h1", "h2"]).where(order > F.col("first")).select("oid", "tid", "line")
    near = _near(docs, distinct.select("first", "halves"))
    gone = exact.union(near).groupBy("oid", "tid").agg(F.collect_set("line").alias("gone"))
    return stored(gone, "gone")


@F.arrow_udf(
    T.StructType(
        [
            T.StructField("text", T.StringType()),
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_removed", T.LongType()),
        ]
    )
)
def _without(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, gone in sliced(batches):
        out: list[bytes | None] = []
        counts: list[tuple[int, int]] = []
        for text, numbers in zip(text_bytes(texts), gone.to_pylist()):
            lines = [] if text is None else text.split(b"\n")
            counts.append((len(lines), len(numbers or ())))
            if numbers:
                drop = set(numbers)
                text = b"\n".join(x for i, x in enumerate(lines) if i not in drop)
            out.append(text)
        yield pa.StructArray.from_arrays(
            [
                pa.array(out, pa.binary()).cast(pa.string()),
                pa.array([n for n, _ in counts], pa.int64()),
                pa.array([n for _, n in counts], pa.int64()),
            ],
            names=["text", "n_lines", "n_removed"],
        )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with their columns, ``text`` without the removed lines, and ``_lines``.

    ``_lines`` (renamed if taken) is a struct of the new text, n_lines and n_removed.
    """
    gone = removed_lines(docs)
    few = gone.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0] <= 1_000_000
    oid, tid, numbers, made = (fresh(docs, c) for c in ("_oid", "_tid", "_gone", "_lines"))
    named = gone.select(F.col("oid").alias(oid), F.col("tid").alias(tid), F.col("gone").alias(numbers))
    rows = docs.withColumns(
        {oid: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), tid: F.xxhash64("text")}
    ).join(F.broadcast(named) if few else named, [oid, tid], "left")
    rows = rows.withColumn(made, _without("text", numbers))
    return rows.select(*docs.columns, F.col(made).alias("_lines") if made == "_lines" else made)


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the shortened texts, and n_chars counted anew."""
    rows = deduplicate(docs)
    new = F.col(rows.columns[-1])["text"]
    values = {"text": new} | ({"n_chars": F.length(new).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[values[c].alias(c) if c in values else F.col(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that stays, for every row."""
    rows = deduplicate(docs.select("doc_id", "text"))
    return rows.select("doc_id", "_lines.n_lines", "_lines.n_removed", "_lines.text")
