import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from barloom.session import session

    shared = tmp_path_factory.mktemp("shared")
    s = session("local[4]", "tests", **{"spark__sql__shuffle__partitions": "4", "spark__driver__memory": "4g", "spark__checkpoint__dir": f"file://{shared}", "spark__ui__showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
