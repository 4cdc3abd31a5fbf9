"""Every query of the reference's operators against its SQL; those without SQL must give stable rows and are held against plain code in other tests."""

import subprocess
import sys
from pathlib import Path

import pytest
from conftest import SF_DIR

from lexmill import queries

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_what_its_sql_gives(name, agree):
    agree(queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.SQL.keys()))
def test_query_without_sql_gives_the_same_rows_again(name, spark):
    a, b = (sorted(map(repr, queries.QUERIES[name](spark, SF_DIR).collect())) for _ in range(2))
    assert a and a == b


def test_entry_can_be_imported_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=60)
