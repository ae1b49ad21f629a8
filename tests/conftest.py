import os
import shutil
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from threadloom.session import local_session, reach_workers  # noqa: E402

DATA = "/root/testdata/sf0.001"
_STARTED: dict = {}


def pytest_sessionstart(session):
    # Column expressions at the top of test modules need a session while they are collected.
    root = tempfile.mkdtemp(prefix="threadloom-tests-")
    settings = {"spark.sql.warehouse.dir": f"{root}/warehouse", "spark.checkpoint.dir": f"file://{root}/shared"}
    _STARTED.update(root=root, spark=reach_workers(local_session("4", 4, **settings)))


def pytest_sessionfinish(session, exitstatus):
    if _STARTED:
        _STARTED["spark"].stop()
        shutil.rmtree(_STARTED["root"], ignore_errors=True)


@pytest.fixture(scope="session")
def spark():
    return _STARTED["spark"]


@pytest.fixture
def data():
    return DATA
