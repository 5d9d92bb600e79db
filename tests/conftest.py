import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
#: Folders that a lazy result reads for as long as its caller likes.
KEPT = ("run-", "pipeline-")


@pytest.fixture(scope="session")
def spark():
    from margin_engine.session import get_session

    s = get_session("local[4]", shuffle_partitions=4, app_name="margin-engine-tests",
                    driver_memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        d = tempfile.mkdtemp(prefix="me-test-ckpt-")
        s.sparkContext.setCheckpointDir(d)
        s.conf.set("spark.checkpoint.dir", d)
    folder = os.path.join(s.conf.get("spark.checkpoint.dir").removeprefix("file:"), "margin-engine")
    earlier = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    yield s
    from margin_engine.plans.materialize import release
    release(s)
    left = set(os.listdir(folder)) - earlier if os.path.isdir(folder) else set()
    assert not [n for n in left if not n.startswith(KEPT)], left
    s.stop()


@pytest.fixture(scope="session")
def sf001():
    return SF001
