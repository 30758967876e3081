import os

import pytest

os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from tidewright.runtime import local_session

    s = local_session(4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
