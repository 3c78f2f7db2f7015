import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from probity.session import local_session, release

    session = local_session(8, "tests")
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def catalog():
    from probity.plans.catalog import load

    return load()


@pytest.fixture(scope="session")
def folder():
    return FOLDER
