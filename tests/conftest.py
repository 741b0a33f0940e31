import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quillgraph.session import session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session("tests", partitions=8)
    made.sparkContext.setLogLevel("ERROR")
    ship(made)
    return made
