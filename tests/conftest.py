import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from tallyforge.session import local_session

    s = local_session(cores=4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def fresh_state():
    """Each test begins and ends with empty session state."""
    from tallyforge.plans import state

    state._CURRENT.__init__()
    yield
    state._CURRENT.__init__()
