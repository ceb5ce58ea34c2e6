import ast
from pathlib import Path

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from tokenloom.plans.catalog import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_no_operator_gathers_or_pairs_everything():
    banned = {"crossJoin", "localCheckpoint", "toPandas", "toLocalIterator", "coalesce_to_one"}
    root = Path(__file__).resolve().parents[1] / "tokenloom"
    for path in root.rglob("*.py"):
        names = {n.attr for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Attribute)}
        assert not names & banned, path


@pytest.fixture(scope="module")
def tables():
    return connect(str(DATA))


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, tables, name):
    assert compare(spark, tables, QUERIES[name], ORACLES[name], str(DATA))[0] == ""


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
def test_entry(spark):
    assert entry.entry(spark).count() == 3
