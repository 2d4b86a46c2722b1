import os
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TESTDATA = Path(os.environ.get("TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    with tempfile.TemporaryDirectory(prefix="wordwood-test-") as scratch:
        session = (
            SparkSession.builder.master("local[8]")
            .appName("wordwood-tests")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "4g")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.checkpoint.dir", scratch)
            .getOrCreate()
        )
        session.sparkContext.setLogLevel("ERROR")
        yield session
        session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    """The smallest tables, for tests that only need some real rows."""
    path = TESTDATA / "sf0.001"
    if not path.exists():
        pytest.skip(f"no test tables at {path}")
    return str(path)
