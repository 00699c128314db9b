import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cases import frame, prose, rows
from pyspark.sql import functions as F

from shotline.llm import repeats, substrings, suffixes
from shotline.llm.common import Sieve


def covered(symbols, times, window):
    hit = [False] * len(symbols)
    for i in range(len(symbols) - window + 1):
        if times[tuple(symbols[i : i + window])] > 1:
            hit[i : i + window] = [True] * window
    return hit


def brute(data, split, join, window, bytes_only):
    texts = [split((t or "").encode()) for _, t, *_ in data]
    times = Counter(tuple(s[i : i + window]) for s in texts for i in range(len(s) - window + 1))
    out = []
    for (doc_id, *_), s in zip(data, texts):
        hit = covered(s, times, window)
        kept = join([x for x, h in zip(s, hit) if not h])
        spans = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        digest = hashlib.sha256(kept).hexdigest()
        out.append((doc_id, len(s), sum(hit), *([spans] if bytes_only else []), digest))
    return sorted(out, key=str)


def cases():
    rng = random.Random(21)
    data = [r for r in rows(n=25) if len(r[1] or "") < 15_000]
    shared = [prose(rng, 30).replace("\n", " ") for _ in range(4)]
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            parts += [prose(rng, rng.randint(0, 12)), s[a : a + rng.randint(20, 200)]]
        data.append((300 + i, " ".join(parts), None, None, None))
    data += [(400, "abab" * 60, None, None, None), (401, "z" * 130, None, None, None), (402, "a b " * 90, None, None, None)]
    return data


@pytest.mark.parametrize("threshold, gram, most", [(40, 8, 4096), (40, 8, 2), (100, 16, 4096)])
def test_bytes_equal_brute_force(spark, threshold, gram, most):
    data = cases()
    got = suffixes.remove_repeats(frame(spark, data), threshold, gram, most)
    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(data, list, bytes, threshold, True)


@pytest.mark.parametrize("window, gram, most", [(35, 8, 4096), (10, 4, 4096), (10, 4, 2)])
def test_words_equal_brute_force(spark, window, gram, most):
    data = cases()
    got = substrings.remove_repeats(frame(spark, data), window, gram, most)
    got = got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(data, bytes.split, b" ".join, window, False)


def test_production_threshold_on_bytes(spark):
    data = rows()
    got = suffixes.remove_repeats(frame(spark, data)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(data, list, bytes, 400, True)


@pytest.mark.parametrize("threshold", [9, 20, 50])
def test_interval_expansion_finds_common_prefixes(threshold):
    rng = np.random.default_rng(threshold)
    base = rng.integers(97, 100, 300, np.uint8)
    parts = []
    for _ in range(12):
        a = rng.integers(0, 200)
        parts.append(bytes(base[a : a + rng.integers(60, 100)]) + bytes(rng.integers(97, 123, rng.integers(1, 30), np.uint8)))
    starts = suffixes.resolve(None, None, parts, threshold)
    times = Counter(p[i : i + threshold] for p in parts for i in range(len(p) - threshold + 1))
    for p, s in zip(parts, starts):
        assert s.tolist() == [i for i in range(len(p) - threshold + 1) if times[p[i : i + threshold]] > 1]


def test_spans_rebuild_the_text(spark):
    data = cases()
    by_id = {r[0]: r[1] for r in data if r[0] is not None}
    for r in suffixes.remove_repeats(frame(spark, data), 40, 8).collect():
        if r.doc_id is not None:
            text = (by_id[r.doc_id] or "").encode()
            at, kept = 0, b""
            for s in r.spans:
                kept, at = kept + text[at : s.lo], s.hi
            assert kept + text[at:] == bytes(r.kept)


def test_empty_table(spark):
    assert suffixes.remove_repeats(frame(spark, [])).count() == 0
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("most", [64, 1 << 25])
def test_sieve_parts_rows_and_loses_no_key(spark, most):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 5_000).alias("key"))
    keys = spark.range(0, 5_000, 10).select(F.col("id").alias("key"))
    sieve = Sieve(keys, ["key"], "sieve-test", most)
    passed = {r.id: r.key for r in sieve.passing(rows).collect()}
    failed = {r.id for r in sieve.failing(rows).collect()}
    assert sieve.passing(rows).columns == ["id", "key"]
    assert len(passed) + len(failed) == 20_000 and not failed & set(passed)
    assert {i for i in range(20_000) if i % 7 and i % 5_000 % 10 == 0} <= set(passed)
    assert sieve.words.count() <= most // 64
    if most > 64:
        assert len(passed) < 5_000


def test_sieve_of_no_keys_passes_nothing(spark):
    sieve = Sieve(spark.range(0), ["id"], "sieve-test")
    assert sieve.passing(spark.range(9)).count() == 0 and sieve.failing(spark.range(9)).count() == 9


def _plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple").split("\n")


def _exchanges(plan, source):
    """The subtrees below hash exchanges that read ``source``."""
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    for i, line in enumerate(plan):
        if "Exchange hashpartitioning" in line:
            below = next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
            tree = "\n".join(plan[i + 1 : below])
            if source in tree:
                yield tree


@pytest.mark.parametrize("method, label", [(suffixes, "suffixes"), (substrings, "substrings")])
def test_shuffles_follow_the_input(spark, monkeypatch, method, label):
    """Small inputs take the joins that large ones take, and only texts that may have repeats are shuffled."""
    plans, keep = {}, repeats.stored

    def spy(df, name):
        plans[name] = _plan(df)
        return keep(df, name)

    monkeypatch.setattr(repeats, "stored", spy)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        result = _plan(method.remove_repeats(frame(spark, cases())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for name in ("kinds", "spans"):
        assert any("SortMergeJoin" in line for line in plans[f"{label}-{name}"]), name
    for plan in (plans[f"{label}-shared"], result):
        of_texts = [t for t in _exchanges(plan, "Scan ExistingRDD") if "xxhash64(1, text" in t]
        assert of_texts and all("LeftSemi" in t for t in of_texts)
