import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from clauseloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


def rows(df, *columns):
    """Sorted tuples of the given columns."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
