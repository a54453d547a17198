import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from sitelens.session import build_session, ensure_checkpoint_dir

    s = build_session("local[2]", app_name="sitelens-tests", shuffle_partitions=4)
    ensure_checkpoint_dir(s)
    yield s
    s.stop()
