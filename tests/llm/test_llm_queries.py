import os

import pytest

import oracle
from gristmill import llm

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "p1_found": ["log_id", "line_no"], "p2_found": ["term"], "p3_found": ["doc_id"], "p4_found": ["doc_id_a", "doc_id_b"],
    "p5_found": ["doc_id"], "p6_found": ["log_id", "line_no"], "p7_found": ["doc_id"], "p10_found": ["doc_id"],
}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    oracle.same(con, llm.queries()[name](spark, FOLDER), llm.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_query_runs(spark, name):
    df = llm.queries()[name](spark, FOLDER)
    assert df.count() >= 0
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert df.count() == df.distinct().count()
