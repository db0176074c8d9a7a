import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    s = local_session(4, 4, "4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA
