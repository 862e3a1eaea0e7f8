import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.path.join(ROOT, "tests"), os.environ.get("PYTHONPATH", "")])  # workers import what tests define


@pytest.fixture(scope="session")
def spark():
    from wordweft.session import local_session

    session = local_session("4", 4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
