"""Substring de-duplication over words: seed and extend.

Seeds are winnowed anchors (see ``repeats``): documents meet where they have an anchor in
common. From an anchor the match is extended word by word to the right and to the left,
for all its occurrences together: two occurrences stay in one class as long as their
words agree. A window around the anchor is repeated if another occurrence is in the
same class on both sides; neighbouring repeated windows join into maximal repeats.
No pair of occurrences is ever formed.

Nulls and edge cases: a null or blank text has no words and loses none; texts of fewer
words than a window are never touched; equal texts (also repeated rows) are repeats of
each other; matches never cross texts.
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
from shotline.llm.hashing import xxh64

WINDOW = 35
GRAM = 8


def _values(words: list[bytes]) -> np.ndarray:
    plain = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
    return xxh64(plain, np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(plain)])), 42)


WORDS = repeats.Unit(split=bytes.split, values=_values, join=b" ".join)


def _classes(group: np.ndarray, words: np.ndarray, start: np.ndarray, room: np.ndarray, step: int, most: int) -> list[np.ndarray]:
    """Class of each occurrence after 0, 1, ... words in direction ``step``; -1 where the stretch ends."""
    now = np.unique(group, return_inverse=True)[1]
    out = [now]
    base = int(words.max(initial=0)) + 1
    for t in range(most):
        alive = (room > t) & (now >= 0)
        if not alive.any():
            break
        key = now[alive] * base + words[start[alive] + step * t]
        now = np.full(len(now), -1)
        now[alive] = np.unique(key, return_inverse=True)[1]
        out.append(now)
    return out


def resolve(group: np.ndarray, anchor: np.ndarray, stretches: list[bytes], window: int) -> list[np.ndarray]:
    """Repeated window starts of each stretch, from the classes left and right of its anchor."""
    ids: dict[bytes, int] = {}
    split = [s.split() for s in stretches]
    words = np.fromiter((ids.setdefault(w, len(ids)) for s in split for w in s), np.int64)
    size = np.array([len(s) for s in split], np.int64)
    begin = np.cumsum(size) - size
    right = _classes(group, words, begin + anchor, size - anchor, 1, window)
    left = _classes(group, words, begin + anchor - 1, anchor, -1, window)
    found: list[list[int]] = [[] for _ in split]
    # windows that begin ``back`` words before the anchor
    for back in range(min(len(left), window + 1)):
        if window - back >= len(right):
            continue
        a, b = left[back], right[window - back]
        rows = np.flatnonzero((a >= 0) & (b >= 0) & (anchor >= back) & (anchor - back + window <= size))
        if not len(rows):
            continue
        key = a[rows] * (int(b.max()) + 1) + b[rows]
        _, where, times = np.unique(key, return_inverse=True, return_counts=True)
        for r in rows[times[where] > 1]:
            found[r].append(int(anchor[r]) - back)
    return [np.array(sorted(f), np.int64) for f in found]


@F.arrow_udf(
    T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_sha256", T.StringType()),
            T.StructField("kept", T.StringType()),
        ]
    )
)
def cut_words(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, spans in sliced(batches):
        rows = []
        for text, found in zip(text_bytes(texts), spans.to_pylist()):
            words = (text or b"").split()
            kept, at = [], 0
            for lo, hi in repeats.merged(found):
                kept += words[at:lo]
                at = hi
            kept += words[at:]
            left = b" ".join(kept)
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left))
        a, b, c, d = zip(*rows) if rows else ([], [], [], [])
        yield pa.StructArray.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(d, pa.binary()).cast(pa.string())],
            names=["n_words", "n_removed", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = repeats.MOST) -> DataFrame:
    """doc_id, word counts, digest and kept text of every row of ``docs``."""
    spans = repeats.repeated_ranges(docs, WORDS, resolve, window, gram, "substrings", most)
    rows = repeats.with_spans(docs, spans, "substrings")
    return rows.select("doc_id", cut_words("text", "spans").alias("_c")).select("doc_id", "_c.*")
