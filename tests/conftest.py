import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from factloom.plans.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    session = local_session(8, **{"spark.checkpoint.dir": f"file://{shared}", "spark.driver.memory": "4g"})
    yield session
    session.stop()
