"""Language identification with a byte convolutional network.

A text is cut into windows of ``WINDOW`` bytes, all of them, the last one padded with
zeros. Filters of two to four bytes slide over a window (one weight per place in the
filter and byte value), the maximum of each filter over the window goes through a
rectifier into a softmax layer. A text's scores are the mean over its windows, weighted by
their bytes. Training (numpy, Adam) uses at most ``SAMPLE`` labelled rows by hash of
doc_id and at most ``PER_ROW`` windows of each; scoring covers every byte of every text.

Filters are evaluated by looking up byte pairs in a table of sums, which gives the
same numbers as one look-up a byte.

Nulls and edge cases: a null text, or one without a letter, is ``und`` with score 0;
rows with null lang are not learned from; without any labelled row all are ``und``;
rows are judged one by one, so repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotline.llm.common import long_texts, text_slices

SAMPLE = 3_000
PER_ROW = 4
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
SEED = 29
LETTER = re.compile(r"[^\W\d_]")


def windows(text: bytes) -> np.ndarray:
    """All windows of a text, (n, WINDOW) bytes, zero padded."""
    raw = np.zeros(-(-max(len(text), 1) // WINDOW) * WINDOW, np.uint8)
    raw[: len(text)] = np.frombuffer(text, np.uint8)
    return raw.reshape(-1, WINDOW)


@dataclass
class Network:
    languages: list[str]
    filters: list[np.ndarray]  # per width: (width, 256, FILTERS)
    bias: np.ndarray
    weights: np.ndarray  # (filters, languages)
    offset: np.ndarray

    def tables(self) -> list[tuple[np.ndarray, ...]]:
        """Per width, sums of neighbouring places for each byte pair, and the odd place."""
        out = []
        for f in self.filters:
            pairs = tuple(
                (f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, len(f) - 1, 2)
            )
            out.append(pairs + ((f[-1],) if len(f) % 2 else ()))
        return out

    def peaks(self, data: np.ndarray, tables: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        """Largest answer of each filter in each window, (n, filters)."""
        pair = data[:, :-1].astype(np.int32) * 256 + data[:, 1:]
        out = []
        for f, parts in zip(self.filters, tables):
            places = WINDOW - len(f) + 1
            total = None
            for k, part in enumerate(parts):
                at = pair[:, 2 * k : 2 * k + places] if len(part) == 65536 else data[:, 2 * k : 2 * k + places]
                value = part[at]
                total = value if total is None else np.add(total, value, out=total)
            out.append(total.max(1))
        return np.maximum(np.concatenate(out, 1) + self.bias, 0)

    def softmax(self, peaks: np.ndarray) -> np.ndarray:
        z = (peaks @ self.weights + self.offset).astype(float)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, texts: list[bytes | None], tables: list[tuple[np.ndarray, ...]]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        has = [t is not None and bool(LETTER.search(t.decode("utf-8", "replace"))) for t in texts]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        rows = [i for i, h in enumerate(has) if h]
        if not rows or not self.languages:
            return names, scores
        parts = [windows(texts[i]) for i in rows]
        owner = np.repeat(np.arange(len(rows)), [len(p) for p in parts])
        data = np.concatenate(parts)
        used = (data != 0).sum(1)
        total = np.zeros((len(rows), len(self.languages)))
        for at in range(0, len(data), 256):
            part = slice(at, at + 256)
            np.add.at(total, owner[part], self.softmax(self.peaks(data[part], tables)) * np.maximum(used[part, None], 1))
        total /= total.sum(1, keepdims=True)
        for i, row in zip(rows, total):
            best = int(np.argmax(row))
            names[i], scores[i] = self.languages[best], float(row[best])
        return names, scores


def learn(data: np.ndarray, y: np.ndarray, languages: list[str], rounds: int = 6) -> Network:
    """Train on windows (n, WINDOW) with language numbers ``y``; cross entropy, Adam."""
    rng = np.random.default_rng(SEED)
    wide = FILTERS * len(WIDTHS)
    net = Network(
        languages,
        [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(wide, np.float32),
        rng.normal(0, 0.2, (wide, max(len(languages), 1))).astype(np.float32),
        np.zeros(max(len(languages), 1), np.float32),
    )
    if len(languages) < 2:
        return net
    params = [*net.filters, net.bias, net.weights, net.offset]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(rounds):
        for pick in np.array_split(rng.permutation(len(y)), -(-len(y) // 64)):
            step += 1
            batch, n = data[pick].astype(np.int64), len(pick)
            peak, where = [], []
            for f in net.filters:
                places = WINDOW - len(f) + 1
                total = sum(f[k][batch[:, k : k + places]] for k in range(len(f)))
                place = total.argmax(1)
                where.append(place)
                peak.append(np.take_along_axis(total, place[:, None, :], 1)[:, 0])
            raw = np.concatenate(peak, 1) + net.bias
            hidden = np.maximum(raw, 0)
            slope = net.softmax(hidden)
            slope[np.arange(n), y[pick]] -= 1
            slope = (slope / n).astype(np.float32)
            back = (slope @ net.weights.T) * (raw > 0)
            grads = []
            for i, f in enumerate(net.filters):
                grad = np.zeros_like(f)
                own = back[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(len(f)):
                    byte = np.take_along_axis(batch, where[i] + k, 1)
                    np.add.at(grad[k], (byte, np.arange(FILTERS)[None, :]), own)
                grads.append(grad)
            grads += [back.sum(0), hidden.T @ slope, slope.sum(0)]
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fit(
    docs: DataFrame,
    size: int = SAMPLE,
    per_row: int = PER_ROW,
    usable: Callable[[Column], Column] | None = None,
) -> Network:
    """Fit on at most ``size`` rows of ``docs`` with text and lang for which ``usable(doc_id)`` holds.

    Languages share the sample evenly. Ids are chosen first, without their texts, by
    hash order in each language; only the chosen texts leave the scan, as windows.
    """
    usable = usable or (lambda doc_id: F.lit(True))
    rows = long_texts(docs).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.where(usable(F.col("doc_id"))).select("doc_id", "lang", "text")
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not languages:
        return learn(np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), [])
    share = max(1, size // len(languages))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = None
    for language in languages:
        part = rows.where(F.col("lang") == language).select("doc_id", "lang").orderBy(*order).limit(share)
        picked = part if picked is None else picked.union(part)
    chosen = rows.join(F.broadcast(picked.distinct()), ["doc_id", "lang"])
    chosen = chosen.select("doc_id", "lang", spaced(per_row)(F.col("text")).alias("w"))
    found = chosen.orderBy(*order, "lang", "w").limit(size).collect()
    number = {language: i for i, language in enumerate(languages)}
    texts = [np.frombuffer(bytes(w), np.uint8) for r in found for w in r.w]
    y = [number[r.lang] for r in found for _ in r.w]
    return learn(np.stack(texts), np.array(y, np.int64), languages)


def spaced(most: int):
    """At most ``most`` windows of each training text, equally spaced over the whole text."""

    @F.arrow_udf("array<binary>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = []
            for texts in text_slices(column):
                for t in texts:
                    w = windows(t or b"")
                    at = np.unique(np.linspace(0, len(w) - 1, most).astype(int))
                    out.append([w[i].tobytes() for i in at])
            yield pa.array(out, pa.list_(pa.binary()))

    return of


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang_pred and score for every row."""

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = net.tables()
        for column in batches:
            names: list[str] = []
            scores: list[float] = []
            for texts in text_slices(column, 1 << 20):
                a, b = net.predict(texts, tables)
                names += a
                scores += b
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"]
            )

    return long_texts(docs).select("doc_id", of("text").alias("_p")).select("doc_id", "_p.lang_pred", "_p.score")
