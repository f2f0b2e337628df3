import pytest

from millrace.plans import registry, store_queries
from tests.parity import connect, same


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, data, con, name):
    same(spark, con, data, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_entry_gives_rows(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fetch_starts_of_a_long_queue(spark, tmp_path):
    """5000 sources of one domain at one time: the last waits more microseconds than an int holds."""
    rows = spark.range(5000).selectExpr("id AS source_document_id", "1L AS job_id", "'a.example' AS domain", "TIMESTAMP '2025-01-01 00:00:00' AS created_at")
    rows.write.parquet(str(tmp_path / "source_documents.parquet"))
    starts = {r[0]: r[1].timestamp() for r in store_queries.sm14(spark, str(tmp_path)).collect()}
    assert starts == {k: starts[0] + 0.5 * k for k in range(5000)}
