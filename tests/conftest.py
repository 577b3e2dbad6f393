import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from folioscope.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("FOLIO_DRIVER_MEMORY", "4g")
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(4, 4, spark_checkpoint_dir=f"file://{shared}/checkpoints", spark_sql_warehouse_dir=f"file://{shared}/warehouse")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
