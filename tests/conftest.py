import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from moneta.session import build_session, checkpoint_dir
    s = build_session(master="local[4]", shuffle_partitions=4, app_name="moneta-tests")
    checkpoint_dir(s)
    yield s


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)
