import pytest

from lyceum.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("local[4]", "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
