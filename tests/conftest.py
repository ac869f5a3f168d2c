import pytest

from porespan.session import spark_session


@pytest.fixture(scope="session")
def spark():
    s = spark_session("tests", 4, 4)
    s.sparkContext.setLogLevel("ERROR")
    return s
