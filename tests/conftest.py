import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("CHRONOLOOM_DRIVER_MEMORY", "4g")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from chronoloom.session import local_session

    session = local_session(4, "tests", spark__sql__shuffle__partitions="4", spark__sql__autoBroadcastJoinThreshold="256k")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
