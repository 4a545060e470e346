import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from edgewise import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session.tune(session.local(4, **{"spark.sql.shuffle.partitions": "2"}))
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture
def hot_keys(monkeypatch):
    """Limits so low that small fixtures take the hot-key paths."""
    from edgewise.operators import components
    from edgewise.plans import skew

    monkeypatch.setattr(skew, "MIN_HOT_ROWS", 5)
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 20)
    monkeypatch.setattr(components, "MIN_HOT_ROWS", 5)
