import sys
from pathlib import Path

import pytest
from hypothesis import settings

settings.register_profile("quarry", deadline=None)
settings.load_profile("quarry")
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from quarry.session import get_spark  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", "4", shuffle_partitions="4", driver_memory="6g", **{"spark.sql.maxMetadataStringLength": "2000"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL
