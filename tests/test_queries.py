"""Every registered query of the core against its SQL, and the driver's contract."""

from __future__ import annotations

import subprocess
import sys

import pytest
from support import ROOT, SF

from tallgrass import catalog_of_queries as catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(name, same_as_sql):
    same_as_sql(catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(name, spark):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry_imports_before_a_session_and_runs(spark):
    code = "import __spark_entry__ as e; assert 'issue_rollup' in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_core_imports_nothing_of_llm():
    code = "import sys, tallgrass.catalog_of_queries, tallgrass.plans.composites, tallgrass.streaming.ledger, tallgrass.sources.files; assert not [m for m in sys.modules if m.startswith('tallgrass.llm')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
