"""A cross-section of registered queries against their SQL twins on the smallest tables."""

import os

import pytest

from __spark_entry__ import oracle_sql, queries
from talentloom.plans.registry import all_queries, all_sql
from tests.compare import database, difference

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "S1_record_ingest", "P10_P11_P15_record_cleaning", "P21_text_quality", "P24_posting_fields", "K2_K3_canonical_names",
    "B5_invariant_violations", "B6_transitive_closure", "J7_J8_J9_evidence", "F1_final_score", "A1_top_ten_per_job",
    "A5_threshold_sweep", "A8_auc", "A12_similarity_matrix", "S4_score_table", "T2_running_unknown_counts", "B7_closure_order",
    "S2_knowledge_files", "S5_result_upsert", "J19_cascade_delete",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_every_query_has_a_twin():
    assert set(all_queries()) == set(all_sql())


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, name):
    left = queries()[name](spark, FOLDER).toPandas()
    assert difference(left, database(FOLDER).execute(oracle_sql()[name]).df()) is None
