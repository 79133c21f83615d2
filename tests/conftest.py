import os

import pytest

from auditloom.session import local_session

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session("8")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF
