import pytest

from outlay.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("8", shuffle_partitions=4, app="outlay-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
