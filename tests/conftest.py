"""One local session for all tests, with a work folder of its own."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from strandweave.session import session

    shared = tmp_path_factory.mktemp("shared")
    out = session("tests", "local[4]", spark__sql__shuffle__partitions="3", spark__sql__codegen__wholeStage="false", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g", spark__checkpoint__dir=f"file://{shared}")
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()
