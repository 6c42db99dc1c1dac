import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from tarnwell.session import get_session

    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--master local[8] --driver-memory 8g pyspark-shell")
    s = get_session("tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
