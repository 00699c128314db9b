import re
from collections import Counter

import numpy as np
from cases import frame, rows

from shotline.llm import rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        dup,
        len(inside),
    )


def test_counts_and_base_rule(spark):
    data = rows() + [(900, "a b c a b c\na b c a b c\n x\n x\nx", None, None, None), (901, "# * <b> 5% ÄÖ É!", None, None, None)]
    got = rules.judge(frame(spark, data), []).collect()
    want = sorted([(d, *brute(t)) for d, t, *_ in data], key=str)
    assert sorted([tuple(r)[:6] for r in got], key=str) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)


def test_learned_list_separates_and_is_applied_by_spark(spark):
    rng = np.random.default_rng(0)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    data, labels = [], []
    for i in range(300):
        kind = i % 5
        w = [words[j] + str(rng.integers(1000)) for j in rng.integers(0, 5, 80)]
        if kind == 0:
            w = [x.upper() + "!!" for x in w]
        if kind == 1:
            w = [x + " |" for x in w]
        data.append((i, " ".join(w), None, None, None))
        labels.append((i, None if i % 7 == 0 else int(kind > 1)))
    docs = frame(spark, data)
    learned = rules.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    verdict = {r.doc_id: r for r in rules.judge(docs, learned).collect()}
    assert all(verdict[i].kept == (i % 5 > 1) for i in range(300))
    kept = rules.kept_documents(docs, learned)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(300) if i % 5 > 1}


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.fit(frame(spark), labels) == []
    assert rules.judge(frame(spark, []), []).count() == 0
