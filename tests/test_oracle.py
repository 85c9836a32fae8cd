"""Every registered query against its SQL, on the smallest tables."""

import pytest

from tests.compare import compare, connect
from workload import load_all

QUERIES, ORACLE = load_all()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE:
        problems = [p for p in compare(df, con, ORACLE[name]) if p != "both results are empty"]
        assert problems == []
    else:
        assert df.count() > 0


def test_only_sql_less_queries_lack_an_oracle():
    assert set(QUERIES) - set(ORACLE) == {"detection_run", "page_text"}
