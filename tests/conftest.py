import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from basketlens.session import local_session

    session = local_session(8, partitions=2, name="basketlens-tests")
    session.sparkContext.setLogLevel("ERROR")
    # Series of a few dozen rows: compiling each plan would cost more than running it.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield session
    session.stop()
