import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE)]

import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.make("tests")
    yield s
    s.stop()
