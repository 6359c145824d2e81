import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("sonarlake-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.default.parallelism", "4").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """The value of an expression over one row of columns."""

    def value(expression, **columns):
        row = spark.range(1).select(*(v.alias(k) for k, v in columns.items())) if columns else spark.range(1)
        return row.select(expression.alias("v")).first()["v"]

    return value
