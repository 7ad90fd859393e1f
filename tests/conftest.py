import pytest

from tidewright.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", app="tidewright-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
