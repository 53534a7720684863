import pytest

from assay.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "tests", "4g")
    s.sparkContext.setLogLevel("ERROR")
    return s
