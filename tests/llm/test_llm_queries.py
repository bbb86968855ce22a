"""The llm queries against their SQL, or run over the smallest tables."""

import pytest
from conftest import DATA
from oracle import compare

from quirelake.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, duck):
    assert compare(spark, duck, name, QUERIES[name], SQL[name], DATA) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_columns(spark):
    want = {
        "p1_found": "field item_id", "p3_found": "chunk_id_a chunk_id_b", "p5_found": "field item_id line_no noise", "p6_found": "field item_id pii_type start_at",
        "p7_found": "query_id chunk_id", "p8_ids": "doc_id ids", "p10_found": "doc_id category",
    }
    for name, cols in want.items():
        assert QUERIES[name](spark, DATA).columns == cols.split()
