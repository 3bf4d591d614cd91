import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from tidescribe.runtime import build_session

    os.environ.setdefault("BENCH_DRIVER_MEMORY", "4g")
    session = build_session("tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    if not DATA.exists():
        pytest.skip("no test data here")
    return str(DATA)
