from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from sessions import make_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return make_session()
