"""Every registered core query against its SQL twin on the smallest tables."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tessera.queries import core_queries, core_sql  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    from tools.compare import sql_tables

    return sql_tables(SF)


@pytest.mark.parametrize("name", sorted(core_queries()))
def test_query(spark, con, name):
    from tools.compare import rows_of

    df = core_queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    if name not in core_sql():
        return
    result = con.execute(core_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, result.fetchall())


def test_the_core_does_not_import_the_llm_package():
    root = Path(__file__).resolve().parents[1] / "tessera"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "tessera.llm" not in path.read_text() and "from .llm" not in path.read_text() and "from ..llm" not in path.read_text(), path
