import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tessera.plans.cut import clean_up
    from tessera.session import local_session

    s = local_session(cores=4, partitions=4, memory="4g")
    yield s
    clean_up(s)
    s.stop()
