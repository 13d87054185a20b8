import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shopscope.session import local_session, scratch_dir  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=8, shuffle_partitions=8, app="shopscope-tests", memory="8g",
                      scratch=scratch_dir("shopscope-test-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def scratch():
    return scratch_dir("shopscope-out-")
