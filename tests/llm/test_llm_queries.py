"""Every query of the subpackage against its SQL."""

import pytest

from tests.compare import database, differences
from tunelake.llm.queries import QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", [name for name, query in QUERIES.items() if query.sql])
def test_query_matches_sql(spark, sf_dir, connection, name):
    assert differences(QUERIES[name].run(spark, sf_dir), connection, QUERIES[name].sql) is None
