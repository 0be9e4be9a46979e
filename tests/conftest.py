from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("DRIFTGRID_DRIVER_MEMORY", "3g")


@pytest.fixture(scope="session")
def spark():
    from driftgrid.session import local_session

    session = local_session("tests", 4, partitions=4)
    yield session
    session.stop()
