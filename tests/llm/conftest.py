import os

import pytest


@pytest.fixture(scope="session")
def data():
    folder = os.environ.get("NEWSMILL_TESTDATA", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    return folder
