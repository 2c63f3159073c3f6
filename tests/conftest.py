import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("barloom-tests", "4", 4)
    s.sparkContext.setLogLevel("OFF")
    return s
