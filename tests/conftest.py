import tempfile

import pytest

from entityloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="6g", app="entityloom-tests", folder=tempfile.mkdtemp(prefix="spark-"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
