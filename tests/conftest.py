import pytest

from quirework.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    return s
