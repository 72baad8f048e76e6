import pytest

from tidemark.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
