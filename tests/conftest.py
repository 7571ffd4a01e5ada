import pytest

from cleanloom.functions.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cores="4", **{"spark.sql.shuffle.partitions": "2", "spark.driver.memory": "4g"})
    ship(s)
    yield s
    s.stop()
