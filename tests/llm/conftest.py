import os

import pytest

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables():
    if not os.path.isdir(TABLES):
        pytest.skip("the test tables are not here")
    return TABLES
