import pytest


@pytest.fixture(scope="session")
def make(spark):
    return lambda data, schema: spark.createDataFrame(data, schema)
