import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """Frames from rows with a column that clashes with names the operators use inside."""

    def make(data, schema, parts=3):
        return spark.createDataFrame(data, schema).repartition(parts)

    return make
