import pytest

from graphloom.session import get_spark, local_checkpoints


@pytest.fixture(scope="session")
def spark():
    session = local_checkpoints(get_spark("tests", master="local[4]"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
