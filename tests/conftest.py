import os
import tempfile

import pytest
from pyspark.sql import SparkSession

os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    return (SparkSession.builder.master("local[4]").appName("tests")
            .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
            .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
            .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
            .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
            .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate())
