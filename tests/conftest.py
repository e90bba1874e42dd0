import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    made = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='riverbend-tests-')}")
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
