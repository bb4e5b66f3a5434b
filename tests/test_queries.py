"""Every registered query against its SQL, or for sense where SQL cannot state it."""

import pytest

from tests.compare import database, differences
from tunelake.plans import QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", [name for name, query in QUERIES.items() if query.sql])
def test_query_matches_sql(spark, sf_dir, connection, name):
    assert differences(QUERIES[name].run(spark, sf_dir), connection, QUERIES[name].sql) is None


def test_adapter_fit_reports_its_run(spark, sf_dir):
    row = QUERIES["adapter_fit"].run(spark, sf_dir).first()
    assert (row["n_losses"], row["epochs"], row["matrix_rows"], row["progress"]) == (12, 3, 3 * 18, 100.0)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    flagship = entry.entry(spark)
    assert flagship.columns == ["conv_id", "turn", "full_text"] and flagship.count() > 0
