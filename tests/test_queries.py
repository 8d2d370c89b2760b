"""Every query of the core against its SQL twin, and those without one for a stable result."""

import oracle
import pytest
from conftest import SF

from panelmill.plans import data_quality, flagship, reference

QUERIES = data_quality.QUERIES | reference.QUERIES | flagship.QUERIES
ORACLE = data_quality.ORACLE | reference.ORACLE | flagship.ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    assert oracle.difference(QUERIES[name](spark, SF), con, ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_repeats_itself(spark, name):
    a, b = (sorted(map(str, QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert a and a == b


def test_entry(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).collect()) == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_workers_need_no_path(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    code = f"""import sys; sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
print("ROWS", e.queries()["p2_found"](spark, {SF!r}).count())"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 7" in done.stdout, done.stderr[-2000:]
