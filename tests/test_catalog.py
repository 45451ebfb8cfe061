import os

import pytest
from oracle import SF_DIR, connection, same

from epiloom.plans.catalog import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    same(spark, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_texts_are_cleaned(spark, tmp_path):
    docs = [(1, " \v" + "word \n" * 50, None), (2, None, 3), (3, " \r\n", 3), (4, "a" + " " * 200_000 + "b \u2028", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.cleaned for r in QUERIES["clean_text"](spark, str(tmp_path)).collect()}
    assert got == {d: t and (t.strip(" \t\n\v\f\r") or None) for d, t, _ in docs}
