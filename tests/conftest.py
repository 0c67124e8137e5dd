import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from gridsmith.testing import local_session

    return local_session(memory="8g")


@pytest.fixture
def rows():
    """Sorted plain tuples of a DataFrame."""

    def collect(df):
        return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))

    return collect
