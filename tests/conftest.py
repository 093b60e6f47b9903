import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("twinfold-tests")
        .config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    from twinfold.plans.settings import drop_tables

    drop_tables(session)
    session.stop()


@pytest.fixture(scope="session")
def people(spark):
    from people_rows import PEOPLE
    from twinfold.sources import with_rid

    rows = spark.createDataFrame(PEOPLE, "id int, name string, age int, gender string, visit_date string")
    return with_rid(rows, key="id").cache()


@pytest.fixture
def small_blocks(spark):
    """Settings that push tiny inputs through the tiled, hot-key and gram paths."""
    for name in ("blockRows", "hotGramRows", "vectorBlockRows"):
        spark.conf.set(f"spark.twinfold.{name}", "7")
    yield
    for name in ("blockRows", "hotGramRows", "vectorBlockRows"):
        spark.conf.unset(f"spark.twinfold.{name}")
