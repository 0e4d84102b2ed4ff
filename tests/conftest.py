import pytest

from deskflow.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    return ship(session)
