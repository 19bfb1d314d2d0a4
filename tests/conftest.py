import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from knownat.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    home = tempfile.mkdtemp(prefix="spark-")
    session = local_session(4, "tests", spark__sql__warehouse__dir=home)
    yield session
    session.stop()


@pytest.fixture()
def make(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)
