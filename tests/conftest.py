from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from foresail.session import local_session  # noqa: E402


# started on import: test modules build literal columns at module level
SESSION = local_session("tests", 8, shuffle_partitions=4)


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()
