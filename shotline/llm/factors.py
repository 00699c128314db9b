"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum is
evaluated in linear time as (|sum_i v_i x_i|^2 - sum_i |v_i x_i|^2) / 2.

Inputs: counts of the lower-cased words of the whole text, hashed into ``BUCKETS``
places and scaled to unit length; the standardised structure statistics of
``rules``; log(1 + n_chars) as metadata. Labels, lang, source and doc_id are no inputs.
The model is fitted in numpy on at most ``SAMPLE`` labelled rows (half of them of
either label where there are enough), chosen by hash of doc_id; its size is fixed,
so it travels with the task. Every row is scored in Spark tasks.

Nulls and edge cases: a null or empty text has no words and zero statistics and is
scored like any other; a null n_chars counts as 0; null labels are not learned from;
without both labels the score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotline.llm.common import long_texts, text_bytes
from shotline.llm.rules import COUNTS, RATIOS, count_text, sampled

SAMPLE = 8_000
BUCKETS = 1 << 14
STATISTICS = len(RATIOS) + 1
FACTORS = 8
SEED = 29


def word_inputs(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct words and their weights, of unit length together."""
    times = Counter((text or b"").lower().split())
    at = np.fromiter(map(zlib.crc32, times), np.int64, len(times)) & (BUCKETS - 1)
    weight = np.log1p(np.fromiter(times.values(), np.float32, len(times)))
    return at.astype(np.int32), weight / max(float(np.sqrt((weight * weight).sum())), 1e-9)


def statistics(text: bytes | None, n_chars: int | None) -> list[float]:
    count = dict(zip(COUNTS, count_text(text)))
    values = [count[a] / max(count[b], 1) if b else np.log1p(count[a]) for a, b in RATIOS.values()]
    return [*values, float(np.log1p(max(n_chars or 0, 0)))]


@F.arrow_udf(
    T.StructType(
        [
            T.StructField("at", T.ArrayType(T.IntegerType())),
            T.StructField("weight", T.ArrayType(T.FloatType())),
            T.StructField("statistics", T.ArrayType(T.DoubleType())),
        ]
    )
)
def inputs(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The inputs of training rows."""
    for text, n_chars in batches:
        words, stats = [], []
        for t, n in zip(text_bytes(text), n_chars.to_pylist()):
            words.append(word_inputs(t))
            stats.append(statistics(t, n))
        yield pa.StructArray.from_arrays(
            [
                pa.array([a for a, _ in words], pa.list_(pa.int32())),
                pa.array([w for _, w in words], pa.list_(pa.float32())),
                pa.array(stats, pa.list_(pa.float64())),
            ],
            names=["at", "weight", "statistics"],
        )


@dataclass
class Machine:
    """Fitted weights: linear (n,), factors (n, FACTORS); statistics follow the word buckets."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.centre) / self.scale, -4, 4).astype(np.float32)

    def score(self, at: np.ndarray, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Scores of rows whose inputs are at[start[i]:start[i+1]] with values x; none is empty."""
        linear = np.add.reduceat(self.linear[at] * x, start)
        vx = self.factors[at] * x[:, None]
        sums = np.add.reduceat(vx, start, axis=0)
        squares = np.add.reduceat((vx * vx).sum(1), start)
        margin = self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares)
        return 1 / (1 + np.exp(-np.clip(margin.astype(float), -30, 30)))

    def score_rows(self, words: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray) -> np.ndarray:
        if not words:
            return np.zeros(0)
        places = np.arange(BUCKETS, BUCKETS + STATISTICS, dtype=np.int32)
        standard = self.standard(stats)
        at = np.concatenate([part for (a, _), _ in zip(words, standard) for part in (a, places)])
        x = np.concatenate([part for (_, w), s in zip(words, standard) for part in (w, s)]).astype(np.float32)
        sizes = np.array([len(a) + STATISTICS for a, _ in words])
        return self.score(at, x, np.cumsum(sizes) - sizes)


def learn(words: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, y: np.ndarray, rounds: int = 12) -> Machine:
    """Logistic loss, adaptive gradient steps over mini-batches."""
    rng = np.random.default_rng(SEED)
    n = BUCKETS + STATISTICS
    share = float(y.mean()) if len(y) else 0.5
    zeros = np.zeros(STATISTICS)
    model = Machine(0.0, np.zeros(n, np.float32), np.zeros((n, FACTORS), np.float32), zeros, zeros + 1)
    if share in (0.0, 1.0) or not len(y):
        model.bias = 0.0 if not len(y) else (4.0 if share else -4.0)
        return model
    model.centre, model.scale = stats.mean(0), stats.std(0) + 1e-6
    model.factors = rng.normal(0, 0.02, (n, FACTORS)).astype(np.float32)
    places = np.arange(BUCKETS, n, dtype=np.int32)
    standard = model.standard(stats)
    rows = [(np.concatenate((a, places)), np.concatenate((w, s)).astype(np.float32)) for (a, w), s in zip(words, standard)]
    g_bias, g_linear, g_factors = 1.0, np.ones(n, np.float32), np.ones((n, FACTORS), np.float32)
    decay = np.float32(1e-4)
    for _ in range(rounds):
        for pick in np.array_split(rng.permutation(len(y)), -(-len(y) // 64)):
            at = np.concatenate([rows[i][0] for i in pick])
            x = np.concatenate([rows[i][1] for i in pick])
            size = np.array([len(rows[i][0]) for i in pick])
            start, row = np.cumsum(size) - size, np.repeat(np.arange(len(pick)), size)
            slope = ((model.score(at, x, start) - y[pick]) / len(pick)).astype(np.float32)
            vx = model.factors[at] * x[:, None]
            sums = np.add.reduceat(vx, start, axis=0)
            dx = slope[row] * x
            spot, back = np.unique(at, return_inverse=True)
            d_linear = np.bincount(back, dx, len(spot)).astype(np.float32) + decay * model.linear[spot]
            part = dx[:, None] * (sums[row] - vx)
            d_factors = np.stack([np.bincount(back, part[:, f], len(spot)) for f in range(FACTORS)], 1)
            d_factors = d_factors.astype(np.float32) + decay * model.factors[spot]
            g_bias += float(slope.sum()) ** 2
            g_linear[spot] += d_linear**2
            g_factors[spot] += d_factors**2
            model.bias -= 0.3 * float(slope.sum()) / g_bias**0.5
            model.linear[spot] -= np.float32(0.5) * d_linear / np.sqrt(g_linear[spot])
            model.factors[spot] -= np.float32(0.2) * d_factors / np.sqrt(g_factors[spot])
    return model


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text falls into ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, usable: Callable[[Column], Column] | None = None) -> Machine:
    """Fit on at most ``size`` rows of ``labels`` for which ``usable(doc_id)`` holds."""
    usable = usable or (lambda doc_id: F.lit(True))
    labels = labels.where(usable(F.col("doc_id")))
    parts = []
    for value in (0, 1):
        picked = sampled(labels.where(F.col("quality") == value), "quality", size // 2)
        rows = long_texts(docs).select("doc_id", "text", "n_chars").join(picked, "doc_id")
        rows = rows.select("doc_id", "_label", inputs("text", F.col("n_chars").cast("long")).alias("i"))
        # repeated ids could make more rows than ids
        rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "i").limit(size // 2)
        parts.append(rows.select("_label", "i").toArrow())
    data = pa.concat_tables(parts).to_pydict()
    words = [(np.array(i["at"], np.int32), np.array(i["weight"], np.float32)) for i in data["i"]]
    stats = np.array([i["statistics"] for i in data["i"]], float).reshape(-1, STATISTICS)
    return learn(words, stats, np.array(data["_label"], float))


def score(model: Machine, text: Column, n_chars: Column) -> Column:
    """Probability of label 1 for every text."""

    @F.arrow_udf("double")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lengths in batches:
            out, words, stats = [np.zeros(0)], [], []
            for t, n in zip(text_bytes(texts), lengths.to_pylist()):
                words.append(word_inputs(t))
                stats.append(statistics(t, n))
                if len(words) == 256:
                    out.append(model.score_rows(words, np.array(stats)))
                    words, stats = [], []
            out.append(model.score_rows(words, np.array(stats).reshape(-1, STATISTICS)))
            yield pa.array(np.concatenate(out))

    return of(text, n_chars.cast("long"))


def classify(docs: DataFrame, model: Machine, bound: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (1 if score >= bound) for every row."""
    rows = long_texts(docs).select("doc_id", score(model, F.col("text"), F.col("n_chars")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= bound).cast("int"))
