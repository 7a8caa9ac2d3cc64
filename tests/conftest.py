import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from hoplens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("hoplens-tests", cores="8", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    before = {}

    def put(name, value):
        before.setdefault(name, spark.conf.get(name))
        spark.conf.set(name, value)

    yield put
    for name, value in before.items():
        spark.conf.set(name, value)
