"""Every registered query against its SQL twin on the small tables."""

import ast
from pathlib import Path

import parity
import pytest

from panelkit.queries import QUERIES, SQL

SF = f"{parity.DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    return parity.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twin(spark, con, name):
    assert parity.differences(QUERIES[name](spark, SF), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_forbidden_calls():
    """No cross joins, local checkpoints or unbounded collects in the package."""
    root = Path(__file__).resolve().parents[1] / "panelkit"
    for path in root.rglob("*.py"):
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Attribute):
                assert node.attr not in {"crossJoin", "localCheckpoint", "collect", "toPandas", "rdd"}, path
