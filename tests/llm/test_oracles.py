import pytest

from tarnwick.llm import queries as Q
from tests.compare import connect, rows

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    found = Q.queries()[name](spark, SMALL).toPandas()
    assert rows(found) == rows(connect(SMALL).execute(Q.oracle_sql()[name]).df())


def test_names():
    assert all(f"p{n}_found" in Q.queries() for n in (1, 2, 3, 4, 5, 6, 7, 8, 10)) and "p9_mix" in Q.queries()
