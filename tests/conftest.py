from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from corpusloom.session import session

    s = session("local[4]", 4, **{"spark__ui__showConsoleProgress": "false", "spark__sql__warehouse__dir": str(tmp_path_factory.mktemp("warehouse")), "spark__checkpoint__dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
