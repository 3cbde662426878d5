import pytest

from veinstone.session import build_session


@pytest.fixture(scope="session")
def spark():
    made = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    made.sparkContext.setLogLevel("ERROR")
    return made
