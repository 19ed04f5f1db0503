from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quireflow.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(cpus=4, shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    yield session
    session.stop()
