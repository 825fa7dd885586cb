import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ratingloom.functions import skew  # noqa: E402
from ratingloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", 4, "6g")
    yield session
    session.stop()


@pytest.fixture
def tiny_limits(monkeypatch):
    """Make small data heavy, so that every skew path runs."""
    for name, value in {"heavy_rows": 4, "slices": 8, "segment_rows": 3}.items():
        monkeypatch.setattr(skew.limits, name, value)
    skew._known.clear()
    yield
    skew._known.clear()
