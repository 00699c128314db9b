"""Registered queries against their SQL twins on the smallest data folder."""

import os

import pytest

from check import compare, connect
from shotline.plans import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
# one or two of each family; check.py runs all of them
SAMPLE = """
s2_embedding_scan s3_path_decomposition s6_threshold_documents s8_latency_export v4_euclidean_l2norm
v6_centroids_unit v8_incremental_centroids j1_score_lookup j7_interval_counts j12_topk_blocked j14_topk_labels
j21_cascade j22_two_stage a3_macro_scores_true_labels a10_severity_shares a15_class_confusion
a16_percentiles_lineitem a19_calibration a20_frozen_threshold a33_mean_of_classifiers a35_unknown_species
a50_file_intervals w5_split_parts w8_forced_sample w10_motion_gate w14_candidate_repair
w15_sliding_members_chunked w16_sliding_events l8_pareto_input u5_alignment b1_bootstrap_ci b6_open_set
b7_scalability p18_resolved_species p20_reordered_candidates t1_stream_events t8_stream_classification
""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_twin(spark, duck, name):
    assert compare(QUERIES[name](spark, FOLDER).toPandas(), duck.execute(SQL[name]).df()) == ""


def test_entry_points():
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries()) and driver.FLAGSHIP in driver.queries()


def test_queries_read_the_given_folder(spark, tmp_path):
    """The same query over a folder with other rows gives other rows."""
    for name in os.listdir(FOLDER):
        os.symlink(f"{FOLDER}/{name}", tmp_path / name)
    os.unlink(tmp_path / "embeddings.parquet")
    half = spark.read.parquet(f"{FOLDER}/embeddings.parquet").where("vec_id % 2 = 0")
    half.write.parquet(f"{tmp_path}/embeddings.parquet")
    wanted = {r["vec_id"] for r in half.select("vec_id").collect()}
    for name in ("j11_nn1", "j21_cascade"):
        got = QUERIES[name](spark, str(tmp_path))
        assert {r["item_id"] for r in got.select("item_id").collect()} <= wanted
        assert got.count() < QUERIES[name](spark, FOLDER).count()
