import os

import pytest
from oracle import SF_DIR, connection, same

from epiloom.llm.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, connection(), QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_every_operator_has_its_query():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))
