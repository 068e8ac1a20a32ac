import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from tidemark.session import CHUNK_ROWS, HOT_ROWS, local_session  # noqa: E402

TINY = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("8")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def cut_small(spark):
    """Make every longer series count as too long for one task."""
    spark.conf.set(CHUNK_ROWS, "8")
    spark.conf.set(HOT_ROWS, "8")
    yield
    spark.conf.unset(CHUNK_ROWS)
    spark.conf.unset(HOT_ROWS)
