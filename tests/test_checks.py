"""Every catalogue query at the smallest scale against its check SQL."""

import pytest
from compare import compare, duck, load

FOLDER = "/root/testdata/sf0.001"
QUERIES, CHECKS = load()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, FOLDER, name, need_rows=False)
    assert ok, note


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)
