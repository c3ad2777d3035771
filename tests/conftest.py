import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from voltaic.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, app_name="voltaic-tests",
                      extra={"spark.driver.memory": "4g"})
    # tests run without a cluster: give the session its own checkpoint folder
    if not s.conf.get("spark.checkpoint.dir", None):
        d = tempfile.mkdtemp(prefix="voltaic-test-ckpt-")
        s.conf.set("spark.checkpoint.dir", d)
        s.sparkContext.setCheckpointDir(d)
    yield s
    s.stop()


@pytest.fixture
def tmp_dir():
    return tempfile.mkdtemp(prefix="voltaic-test-")
