from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark():
    from quire.session import local_session, ship

    session = local_session(4, **{"spark.sql.shuffle.partitions": "4"})
    ship(session)
    yield session
    session.stop()
