import numpy as np
from cases import crc, frame, rows
from pyspark.sql import functions as F

from shotline.llm import factors


def test_linear_time_score_equals_all_pairs():
    rng = np.random.default_rng(4)
    n = factors.BUCKETS + factors.STATISTICS
    zero = np.zeros(factors.STATISTICS)
    m = factors.Machine(0.3, rng.normal(size=n).astype(np.float32), rng.normal(size=(n, 8)).astype(np.float32), zero, zero + 1)
    at, x = rng.choice(n, 9, replace=False), rng.normal(size=9).astype(np.float32) / 3
    pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(9) for j in range(i))
    want = 1 / (1 + np.exp(-(0.3 + m.linear[at] @ x + pairs)))
    assert np.allclose(m.score(at, x, np.array([0])), want, atol=1e-4)


def test_held_out_rows_are_classified(spark):
    rng = np.random.default_rng(1)
    data, labels = [], []
    for i in range(400):
        words = [f"w{j}" for j in rng.integers(0, 300, 60)]
        if i % 3 == 0:
            words = [w.upper() + "!!" for w in words]
        data.append((i, " ".join(words), "en", "s", 100))
        labels.append((i, int(i % 3 > 0), 0))
    docs = frame(spark, data)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fold = lambda d: factors.held_out(d, 5, 0)
    model = factors.fit(docs, labels, usable=lambda d: ~fold(d))
    got = factors.classify(docs, model).withColumn("held_out", fold(F.col("doc_id"))).collect()
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) for r in got)
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in got if r.held_out]) > 0.95
    again = factors.classify(docs, factors.fit(docs, labels, usable=lambda d: ~fold(d))).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in got}


def test_awkward_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = factors.fit(frame(spark), none)
    got = factors.classify(frame(spark), model).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert factors.classify(frame(spark, []), model).count() == 0
