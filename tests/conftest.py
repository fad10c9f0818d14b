import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g", "spark.sql.session.timeZone": "UTC", "spark.default.parallelism": "4"}
    s = SparkSession.builder.master("local[4]").appName("tests").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    s.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (repo, os.environ.get("PYTHONPATH", "")) if x)
    yield s
    s.stop()
