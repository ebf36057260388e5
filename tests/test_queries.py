import importlib.util
from pathlib import Path

import pytest

from tarnwick.queries.registry import load_core
from tests.compare import connect, rows

SMALL = "/root/testdata/sf0.001"
QUERIES = load_core()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    q = QUERIES[name]
    assert q.rows, "names the operators it stands for"
    found = q.run(spark, SMALL).toPandas()
    assert found.columns.is_unique
    if q.sql:
        expected = duck.execute(q.sql).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows(found) == rows(expected)


def test_entry_module(spark):
    spec = importlib.util.spec_from_file_location("entry_module", Path(__file__).parent.parent / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
