import pytest

from gridloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("gridloom-tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g",
                                                               "spark.default.parallelism": "8"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sliced(spark):
    """Every group counts as too large for one task, so the sliced plans run on small data."""
    names = {"groupRows": "1", "topRows": "2", "exactValues": "3"}
    for name, value in names.items():
        spark.conf.set(f"spark.gridloom.{name}", value)
    yield
    for name in names:
        spark.conf.unset(f"spark.gridloom.{name}")
