import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bazaar.session import build_session, checkpoint_root  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("bazaar-tests", cpus=4, shuffle_partitions=8,
                      extra={"spark.ui.showConsoleProgress": "false",
                             "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="bazaar-wh-")})
    checkpoint_root(s)
    yield s
    s.stop()
