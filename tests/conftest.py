import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from meterflow.session import build_session
    work = tempfile.mkdtemp(prefix="meterflow-test-")
    s = build_session("local[8]", "meterflow-tests", 8,
                      extra={"spark.checkpoint.dir": work,
                             "spark.driver.memory": "8g",
                             "spark.sql.streaming.stateStore.providerClass":
                                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fx_small(spark):
    from meterflow.sources.fixtures import Fixtures
    return Fixtures(spark, SF_SMALL)


@pytest.fixture(scope="session")
def duck_small():
    from tests.oracle import duck
    return duck(SF_SMALL)


@pytest.fixture(scope="session")
def duck_mid():
    from tests.oracle import duck
    return duck(SF_MID)
