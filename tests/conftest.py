import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.driver.extraJavaOptions", "-XX:+UseSerialGC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.sparkContext.getCheckpointDir():
        shared = str(tmp_path_factory.mktemp("shared"))
        session.sparkContext.setCheckpointDir(shared)
    yield session
    session.stop()


@pytest.fixture
def conf(spark):
    """conf({key: value}): settings for the time of a test."""
    before = {}

    def put(settings):
        for key, value in settings.items():
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def table(spark):
    """table("name", rows): a frame with the declared schema of that table."""
    from cleanlake.schemas import SCHEMAS

    def make(name, rows):
        return spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1)

    return make


@pytest.fixture
def ids():
    def read(frame, column="id"):
        return sorted(r[0] for r in frame.select(column).collect())

    return read
