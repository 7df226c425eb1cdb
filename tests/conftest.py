import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from vendorlens.session import local_session
    s = local_session("*", shuffle_partitions=8, app="vendorlens-tests")
    yield s
    s.stop()
