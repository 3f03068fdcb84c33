import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from varve.session import session  # noqa: E402




@pytest.fixture(scope="session")
def spark():
    found = session(4, "tests", partitions=4)
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


@pytest.fixture(scope="session")
def sf():
    from compare import DATA

    return DATA
