import pytest

from tarnfield.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
