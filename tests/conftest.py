import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from churnkit.session import configure
    s = (SparkSession.builder.master("local[4]").appName("churnkit-tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    configure(s)
    # tests only: the cluster names spark.checkpoint.dir; locally it is unset
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="churnkit-test-ckpt-"))
    yield s


SF = "/root/testdata/sf0.001"
