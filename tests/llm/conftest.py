import os

import pytest


@pytest.fixture(scope="session")
def tokenizers_dir():
    P = pytest.importorskip("public_tokenizers")
    return lambda name: P.path(name)


@pytest.fixture(scope="session")
def sf():
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    return d
