"""Suffix-array de-duplication of long byte strings by bounded interval expansion.

``repeats`` narrows the corpus to stretches of bytes that share an anchor with a
different stretch, and brings those of an anchor together. There, over the concatenated
stretches:

* the suffixes are sorted (by ranks of prefixes of growing length, up to the threshold)
  and the Burrows-Wheeler transform and its last-to-first mapping are taken from them;
* common prefixes are derived by increasing length, breadth first: an interval holds
  all suffixes that begin with one string; for each byte before them the mapping leads to
  the interval of the string extended backward by that byte; where its right border is
  not yet known, the common prefix there is the present length, and the interval
  goes on to the next round;
* the rounds stop at the threshold. Borders still unknown then are between suffixes
  with a common prefix of at least the threshold: the repeated strings.

Nulls and edge cases: a null or empty text has no bytes and loses none; texts below the
threshold are never touched; equal texts (also repeated rows) are repeats of each
other and lose every byte if long enough; matches never cross texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotline.llm import repeats
from shotline.llm.common import sliced, text_bytes
from shotline.llm.hashing import mix

THRESHOLD = 400
GRAM = 64
FIRST = 8  # bytes compared by the first sort
BORDER = 0xFF  # no byte of UTF-8
VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

BYTES = repeats.Unit(split=bytes, values=lambda s: VALUES[np.frombuffer(s, np.uint8)], join=bytes)


def suffix_order(raw: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` bytes, and where the first FIRST bytes change."""
    n = len(raw)
    padded = np.concatenate((raw, np.full(FIRST, BORDER, np.uint8)))
    key = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    value = key[order]
    change = np.concatenate(([True], value[1:] != value[:-1]))
    begins = change.copy()
    size = FIRST
    rank = np.empty(n, np.int64)
    while size < depth:
        # ranks name groups by their first place, so that refined groups keep their slots
        group = np.maximum.accumulate(np.where(change, np.arange(n), 0))
        rank[order] = group + 1
        open_ = np.flatnonzero(~(change & np.concatenate((change[1:], [True]))))
        if not len(open_):
            break
        some = order[open_]
        deeper = np.zeros((2, len(some)), np.int64)
        for k in (1, 2):
            at = some + k * size
            inside = at < n
            deeper[k - 1, inside] = rank[at[inside]]
        # groups stay in place: sort by (group, next rank, the one after)
        if n < 1 << 21:
            key = (rank[some] << 42) | (deeper[0] << 21) | deeper[1]
            by = np.argsort(key, kind="stable")
        else:
            by = np.lexsort((deeper[1], deeper[0], rank[some]))
        order[open_] = some[by]
        a, b = deeper[0][by], deeper[1][by]
        differs = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        change[open_] |= differs
        size *= 3
    return order, begins


def repeated_suffixes(raw: np.ndarray, threshold: int) -> np.ndarray:
    """Whether the ``threshold`` bytes from each place on occur elsewhere too.

    Only places with no BORDER in these bytes have a meaningful answer.
    """
    n = len(raw)
    order, known = suffix_order(raw, threshold)
    known = np.concatenate((known, [True]))  # common prefix with the suffix before is known
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = raw[order - 1]  # the transform; the first suffix sees the last byte, a border
    back = place[order - 1]
    # all strings of FIRST bytes without a border
    low = np.flatnonzero(known[:-1])
    high = np.flatnonzero(known[1:])
    edges = np.concatenate(([0], np.cumsum(raw == BORDER)))
    first = order[low]
    clear = edges[np.minimum(first + FIRST, n)] == edges[first]
    low, high = low[clear], high[clear]
    for _ in range(FIRST, threshold):
        if not len(low):
            break
        size = high - low + 1
        offset = np.cumsum(size) - size
        rows = np.repeat(low - offset, size) + np.arange(size.sum())
        byte, target = before[rows], back[rows]
        least, most = np.minimum.reduceat(byte, offset), np.maximum.reduceat(byte, offset)
        single = (least == most) & (least != BORDER)
        new_low = np.minimum.reduceat(target, offset)[single]
        new_high = np.maximum.reduceat(target, offset)[single]
        several = ~single & ~((least == most) & (least == BORDER))
        if several.any():
            inside = np.repeat(several, size) & (byte != BORDER)
            owner = np.repeat(np.arange(len(size)), size)[inside]
            key = owner * 256 + byte[inside]
            by = np.argsort(key, kind="stable")
            key, target = key[by], target[inside][by]
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            new_low = np.concatenate((new_low, np.minimum.reduceat(target, cut)))
            new_high = np.concatenate((new_high, np.maximum.reduceat(target, cut)))
        fresh = ~known[new_high + 1]
        low, high = new_low[fresh], new_high[fresh]
        known[high + 1] = True
    shared = np.empty(n, bool)
    shared[order] = ~known[:-1] | ~known[1:]
    return shared


def resolve(_: np.ndarray, __: np.ndarray, stretches: list[bytes], window: int) -> list[np.ndarray]:
    """Repeated window starts of each stretch."""
    border = bytes([BORDER])
    raw = np.frombuffer(border.join(stretches) + border, np.uint8)
    shared = repeated_suffixes(raw, window)
    out, at = [], 0
    for s in stretches:
        out.append(np.flatnonzero(shared[at : at + len(s) - window + 1]))
        at += len(s) + 1
    return out


@F.arrow_udf(
    T.StructType(
        [
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("n_spans", T.LongType()),
            T.StructField("kept_sha256", T.StringType()),
            T.StructField("kept", T.BinaryType()),
            T.StructField(
                "spans", T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))
            ),
        ]
    )
)
def cut_spans(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, spans in sliced(batches):
        rows = []
        for text, found in zip(text_bytes(texts), spans.to_pylist()):
            text, gone = text or b"", repeats.merged(found)
            kept, at = [], 0
            for lo, hi in gone:
                kept.append(text[at:lo])
                at = hi
            left = b"".join([*kept, text[at:]])
            removed = [{"lo": lo, "hi": hi} for lo, hi in gone]
            rows.append((len(text), len(text) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left, removed))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        kinds.append(pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
        columns = list(zip(*rows)) if rows else [[]] * 6
        yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM, most: int = repeats.MOST) -> DataFrame:
    """doc_id, counts, digest, kept bytes and removed spans of every row of ``docs``."""
    spans = repeats.repeated_ranges(docs, BYTES, resolve, threshold, gram, "suffixes", most)
    rows = repeats.with_spans(docs, spans, "suffixes")
    return rows.select("doc_id", cut_spans("text", "spans").alias("_c")).select("doc_id", "_c.*")
