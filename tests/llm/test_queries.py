import pytest

from millrace.llm import queries
from tests.parity import connect, same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, data, name):
    same(spark, connect(data), data, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert df.count() > 0 and df.columns


FOUND = {
    "p1_found": "record_id_a bigint, record_id_b bigint", "p2_found": "result_id bigint", "p3_found": "record_id bigint", "p4_found": "input_id bigint", "p5_found": "record_id bigint, field string, ref_id bigint",
    "p6_found": "field string, row_id bigint, line_no bigint", "p7_found": "source_document_id bigint, line_no bigint", "p8_ids": "doc_id bigint, ids array<int>", "p9_found": "doc_id bigint, item_id bigint", "p10_found": "doc_id bigint",
}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_result_columns(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == FOUND[name]
    if name != "p8_ids":
        rows = df.collect()
        assert len(rows) == len(set(rows))
