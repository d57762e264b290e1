import pytest


@pytest.fixture(scope="session")
def spark():
    from corpuscope.session import get_session
    yield get_session("local[*]", 8)
