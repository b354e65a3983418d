from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def make_spark() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .appName("terragrid-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


@pytest.fixture(scope="session")
def spark():
    session = make_spark()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
