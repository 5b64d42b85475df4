import pytest

from affinia.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "6g", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
