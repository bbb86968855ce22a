import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quirelake.session import local_session

    s = local_session(8, "6g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from oracle import views

    return views(DATA)
