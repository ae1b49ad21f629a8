"""The registered training-data queries run on the smallest tables and match their SQL."""

import pytest

import oracle
from threadloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    if name in queries.ORACLES:
        oracle.compare(spark, queries.QUERIES[name], queries.ORACLES[name], data)
    else:
        assert queries.QUERIES[name](spark, data).count() > 0


def test_found_columns(spark, data):
    want = {
        "p1_found": [("entry_id", "bigint"), ("turn_no", "int"), ("range_start", "int")],
        "p3_found": [("entry_id", "bigint"), ("field_name", "string"), ("char_start", "int"), ("char_end", "int"), ("pii_kind", "string")],
        "p4_found": [("id_a", "bigint"), ("id_b", "bigint")],
        "p5_found": [("conv_ref", "string")],
        "p6_found": [("doc_id", "bigint"), ("item_id", "bigint")],
        "p8_found": [("doc_id", "bigint")],
    }
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, data).dtypes == columns
