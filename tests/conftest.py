import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.session import clear_work, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "millrace-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    clear_work(session)
    session.stop()
