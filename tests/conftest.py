from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from panelmill.session import local_session

    return local_session("*", "panelmill-tests", 8)


@pytest.fixture(scope="session")
def con():
    import oracle

    return oracle.connect(SF)


@pytest.fixture(autouse=True, scope="module")
def _uncache(request):
    yield
    from pyspark.sql import SparkSession

    if session := SparkSession.getActiveSession():
        session.catalog.clearCache()
