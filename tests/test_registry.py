import os

import pytest

import __spark_entry__ as entry
from siteloom import plans

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_plans_stay_native(spark):
    for name in ("page_signals", "site_scorecard", "link_summary", "image_summary", "security_headers", "lighthouse_findings", "redact_documents"):
        plan = plans.queries()[name](spark, SF)._jdf.queryExecution().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan, name


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry_needs_no_session():
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert done.returncode == 0
