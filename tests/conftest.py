import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(cores=4, **{"spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted tuples of the named columns."""

    def get(df, *columns):
        return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)

    return get
