import pytest

from strandline.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, memory="8g", app="tests")
