"""Quality rules: a decision list learned by sequential covering, applied as Spark conditions.

Every whole text is reduced to counts; ratios of them are the statistics. From a
bounded sample of labelled rows (``SAMPLE`` rows by hash of doc_id, the only bound
here) rules are learned one after another: a conjunction of thresholds is grown on
two thirds of the rows still uncovered by the best information gain, cut back on
the other third, and accepted when it is precise enough there; the rows it covers
leave. The list becomes one ordered ``CASE WHEN`` over the statistics, evaluated for
every row by Spark.

Nulls and edge cases: a null, empty or blank text has zero counts and fails the base
rule; labels that are null or other than 0 and 1 are not learned from; without
labels the list is empty and only the base rule rejects; rows are judged one by one,
so repeated rows and ids get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotline.llm.common import fresh, long_texts, stored, text_bytes

SAMPLE = 20_000
SYMBOLS = b"#*$%&|<>"
COUNTS = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_distinct_words",
    "n_upper",
    "n_digits",
    "n_exclaims",
    "n_bars",
    "n_stops",
]
#: statistic: (count, per which count)
RATIOS = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "exclaim_share": ("n_exclaims", "n_words"),
    "bar_share": ("n_bars", "n_words"),
    "stop_share": ("n_stops", "n_words"),
}


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside ``window``-word windows that occur twice or more, first ones included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, i) for i, w in enumerate(words)), np.int64, len(words))
    code = ids[:n]
    for k in range(1, window):
        both = code * len(words) + ids[k : k + n]
        code = np.unique(both, return_inverse=True)[1] if k < window - 1 and len(words) > 1 << 20 else both
    _, where, times = np.unique(code, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(times[where] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def count_text(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    raw = np.frombuffer(text, np.uint8)
    at = np.bincount(raw, minlength=256)
    lines = [x for x in text.split(b"\n") if x.strip()]
    # capitals: A-Z, and the two-byte letters C3 80 to C3 9E
    two = raw[1:][raw[:-1] == 0xC3] if at[0xC3] else raw[:0]
    return (
        len(words),
        len(raw) - int(at[0x80:0xC0].sum()) - int(at[9:14].sum()) - int(at[32]),
        int(at[list(SYMBOLS)].sum()),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
        int(at[65:91].sum()) + int((two < 0x9F).sum()),
        int(at[48:58].sum()),
        int(at[33]),
        int(at[124]),
        int(at[46]),
    )


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The counts of each text as a struct."""
    for column in batches:
        rows = np.array([count_text(t) for t in text_bytes(column)], np.int64).reshape(-1, len(COUNTS))
        yield pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(COUNTS))], names=COUNTS)


def ratio(name: str, of: Column) -> Column:
    """One statistic as a double, from the struct of counts."""
    count, per = RATIOS[name]
    value = of[count].cast("double")
    return value if per is None else value / F.greatest(of[per], F.lit(1)).cast("double")


def base_failed(of: Column) -> Column:
    return (of["n_words"] < 50) | (of["n_repeat_words"] * 100 > of["n_words"] * 50)


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    bound: float

    def of(self, counted: Column) -> Column:
        value = ratio(self.statistic, counted)
        return value > self.bound if self.above else value <= self.bound

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.bound:.6g}"


Rule = tuple[Condition, ...]


def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    """First-order information gain of keeping p of p0 wanted and n of n0 other rows."""
    with np.errstate(divide="ignore", invalid="ignore"):
        value = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, value, -np.inf)


def _best_condition(x: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[float, Condition | None]:
    best, found = 1e-9, None
    p0, n0 = int(y.sum()), int((~y).sum())
    for k, name in enumerate(names):
        order = np.argsort(x[:, k], kind="stable")
        value, hit = x[order, k], y[order]
        cut = np.flatnonzero(value[1:] > value[:-1])
        if not len(cut):
            continue
        p = np.cumsum(hit)[cut]
        n = cut + 1 - p
        for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
            gain = _gain(pp, nn, p0, n0)
            i = int(np.argmax(gain))
            if gain[i] > best:
                bound = (value[cut[i]] + value[cut[i] + 1]) / 2
                best, found = float(gain[i]), Condition(name, above, float(bound))
    return best, found


def _covers(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        value = x[:, names.index(c.statistic)]
        out &= value > c.bound if c.above else value <= c.bound
    return out


def learn(x: np.ndarray, y: np.ndarray, names: list[str], precision: float = 0.9, most: int = 4) -> list[Rule]:
    """Ordered rules for the rows where ``y`` is true; rows come in a random order."""
    rules: list[Rule] = []
    left = np.ones(len(y), bool)
    while y[left].sum() >= 3:
        rows = np.flatnonzero(left)
        prune = np.arange(len(rows)) % 3 == 2
        gx, gy, px, py = x[rows[~prune]], y[rows[~prune]], x[rows[prune]], y[rows[prune]]
        rule: Rule = ()
        inside = np.ones(len(gy), bool)
        while len(rule) < most and gy[inside].any() and not gy[inside].all():
            _, condition = _best_condition(gx[inside], gy[inside], names)
            if condition is None:
                break
            rule += (condition,)
            inside = _covers(rule, gx, names)

        def worth(r: Rule) -> float:
            hit = _covers(r, px, names)
            p, n = int(py[hit].sum()), int((~py[hit]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        if rule:
            rule = max((rule[:i] for i in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))
        hit = _covers(rule, x[rows], names)
        good, pruned = y[rows][hit], _covers(rule, px, names)
        if not rule or good.sum() < 3 or good.mean() < precision or (pruned.any() and py[pruned].mean() < precision):
            break
        rules.append(rule)
        left[rows[hit]] = False
    return rules


def sampled(labels: DataFrame, label: str, size: int) -> DataFrame:
    """At most ``size`` labelled ids, by hash; small by construction, hence broadcast."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    ids = ids.select("doc_id", F.col(label).cast("int").alias("_label"))
    return F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(size))


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> list[Rule]:
    """Rules that reject what ``labels.quality`` marks 0, learned where the base rule passes."""
    names = list(RATIOS)
    known = long_texts(docs).select("doc_id", "text").join(sampled(labels, "quality", size), "doc_id")
    # stored, since a filter on the counts would be moved below the join and count every text
    known = stored(known.select("doc_id", "_label", counts("text").alias("_counts")), "rule-sample")
    rows = (
        known.where(~base_failed(F.col("_counts")))
        .select("doc_id", "_label", *[ratio(n, F.col("_counts")).alias(n) for n in names])
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_label", *names)
        .limit(size)
        .toPandas()
    )
    if not len(rows):
        return []
    return learn(rows[names].to_numpy(float), rows["_label"].to_numpy() == 0, names)


def fired(rules: list[Rule], of: Column) -> Column:
    """Number (from 1) of the first rule that holds, null if none does."""
    out = F.lit(None).cast("int")
    for number in range(len(rules), 0, -1):
        holds = F.lit(True)
        for condition in rules[number - 1]:
            holds = holds & condition.of(of)
        out = F.when(holds, F.lit(number)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the base counts, base_failed, the rule that fired and kept, for every row."""
    rows = long_texts(docs).select("doc_id", counts("text").alias("_counts"))
    of = F.col("_counts")
    rows = rows.select(
        "doc_id",
        *[of[c].alias(c) for c in COUNTS[:5]],
        base_failed(of).alias("base_failed"),
        fired(rules, of).alias("rule"),
    )
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def kept_documents(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    name = fresh(docs, "_counts")
    of = F.col(name)
    return long_texts(docs).withColumn(name, counts("text")).where(~base_failed(of) & fired(rules, of).isNull()).drop(name)
