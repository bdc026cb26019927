import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from claimlens.session import local_session
    s = local_session(cores=4, shuffle_partitions=8, app="claimlens-tests")
    yield s
    s.stop()
