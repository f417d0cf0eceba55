"""Every query with SQL against DuckDB; all of them run and keep their columns."""
import pytest

import __spark_entry__ as entry
from check import compare
from rastrum.llm import queries as q
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_sql(spark, oracle, name):
    msg, ok, _ = compare(spark, oracle, name, q.QUERIES[name], q.ORACLES[name], SMALL)
    assert ok, msg


def test_all_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
