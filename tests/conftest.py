import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from claimscope.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"
