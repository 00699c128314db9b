import math
import random

import pytest
from pyspark.sql import functions as F

from shotline.llm import topk


def brute(data, k=5):
    ready = {}
    for vec_id, v in data:
        if vec_id is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ready[(vec_id, tuple(math.floor(256 * x) for x in v))] = None
    out = []
    for q, u in ready:
        if q % 50 == 0:
            scores = [(-sum(a * b for a, b in zip(u, v)), p) for p, v in ready if p != q]
            out += [(q, i + 1, p, -s) for i, (s, p) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [topk.BLOCK_BYTES, 400])
@pytest.mark.parametrize("bucket", [topk.BUCKET, 16])
def test_equals_brute_force(spark, block, bucket):
    rng = random.Random(8)
    base = [rng.gauss(0, 1) for _ in range(6)]
    data = []
    for i in range(400):
        size = rng.choice([0.01, 1.0, 1.0, 5.0])
        near = [b + rng.gauss(0, 0.01) for b in base]
        v = near if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(6)]
        data.append((i, [x * size for x in v]))
    data += [(600 + i, list(base)) for i in range(20)]  # ties
    data += [(700, [0.0] * 6), (750, [0.0] * 6), (None, base), (701, None), (702, [1.0, None]), (703, [float("nan")] * 6)]
    data += [(704, [float("inf")] * 6), (705, []), (706, [1.0, 2.0]), (800, [-1.0] * 6), (850, [1e9] * 6), data[0], data[7]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "norm": F.lit(2)})
    rows = topk.usable(df).select("vec_id", topk.whole_numbers(F.col("embedding")).alias("v"))
    got = topk.top_k(rows, F.col("vec_id") % 50 == 0, block_bytes=block, bucket=bucket)
    assert sorted(tuple(r) for r in got.collect()) == brute(data)


def test_few_and_no_rows(spark):
    for data in ([(0, [1.0]), (1, [0.5])], []):
        rows = spark.createDataFrame(data, "vec_id long, e array<double>")
        rows = rows.select("vec_id", topk.whole_numbers(F.col("e")).alias("v"))
        assert topk.top_k(rows, F.col("vec_id") % 50 == 0).count() == (1 if data else 0)
