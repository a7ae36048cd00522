import os

import pytest


@pytest.fixture(scope="session")
def sf():
    """The smallest set of tables."""
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    return path
