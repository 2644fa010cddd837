import duckdb
import pytest

from tests import cases


@pytest.fixture(scope="module")
def duck():
    return duckdb.connect()


@pytest.mark.parametrize("name", sorted(cases.QUERIES))
def test_documents_made_up_by_hand(spark, duck, name):
    got = sorted(map(str, map(tuple, cases.QUERIES[name](spark, "").select("source", "field", "value").collect())))
    want = sorted(map(str, duck.sql(f"select source, field, value from ({cases.ORACLES[name]})").fetchall()))
    assert got == want
