import os

import corpus_pipeline
import pytest
from cases import frame, rows
from test_lines import brute as brute_lines
from test_packing import PATH, check
from test_simhash import jaccard_groups

from shotline.llm import mixing, rules
from shotline.llm.common import table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def test_stages_in_a_row_equal_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]

    kept = stages[0](spark, docs, FOLDER)
    verdict = rules.judge(docs, rules.fit(docs, table(spark, FOLDER, "labels"))).where("kept").select("doc_id").collect()
    data = [tuple(r) for r in kept.collect()]
    assert kept.columns == columns and sorted(r[0] for r in data) == sorted(r.doc_id for r in verdict)

    docs = spark.createDataFrame(data, docs.schema)
    short = stages[1](spark, docs, FOLDER)
    want = {d: t for d, _, _, t in brute_lines(data)}
    data = [tuple(r) for r in short.collect()]
    assert short.columns == columns and {r[0]: r[1] for r in data} == want
    assert all(r[4] == len(r[1]) for r in data)

    docs = spark.createDataFrame(data, docs.schema)
    single = stages[2](spark, docs, FOLDER)
    data.sort()
    blank = [r[0] for r in data if not r[1].split()]
    worded = [r for r in data if r[1].split()]
    want = {worded[c][0] for c in jaccard_groups([r[1] for r in worded])[2].tolist()}
    data = [tuple(r) for r in single.collect()]
    assert single.columns == columns and sorted(r[0] for r in data) == sorted(want | set(blank[:1]))

    docs = spark.createDataFrame(data, docs.schema).repartition(3)
    mixed = stages[3](spark, docs, FOLDER)
    order = [r.doc_id for r in mixed.collect()]
    placed = {r.doc_id: (r.slot, r.place) for r in mixing.report(docs).collect()}
    assert mixed.columns == columns and order == sorted(placed, key=placed.get)

    assert corpus_pipeline.TOKENIZER == PATH
    check(stages[4](spark, mixed, FOLDER).collect(), (4096, 128, 4096), data)


def test_awkward_rows_go_through(spark):
    docs = frame(spark)
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, FOLDER)
        if name != "sequence packing":
            assert out.columns == docs.columns
            assert out.count() == len(rows()) if name != "simhash near-dedup" else out.count() < len(rows())
        else:
            assert out.count() >= len(rows())


def test_run_gives_sequences(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
