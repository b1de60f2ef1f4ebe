import pytest

from tests.compare import connect
from tidemark.session import session

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    made = session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "4g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    made.sparkContext.setLogLevel("OFF")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def db():
    return connect(FOLDER)


@pytest.fixture(scope="session")
def folder():
    return FOLDER
