import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dossierlake.session import local_session, scratch_path  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def folder(spark):
    """Names new folders in the shared scratch space."""
    return lambda label: scratch_path(spark, f"test-{label}")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
