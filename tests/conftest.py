from __future__ import annotations

import os
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark():
    from tersa.session import session

    return session("local[4]", "tests", spark__driver__memory="4g", spark__sql__shuffle__partitions="4")


@pytest.fixture(scope="session")
def small() -> str:
    return "/root/testdata/sf0.001"
