import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from envlake.session import get_session
    s = get_session(master="local[8]", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF_SMALL
