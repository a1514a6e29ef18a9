import pytest


@pytest.fixture
def write(tmp_path, spark):
    """Write rows as a table of a fresh input folder; returns the folder."""

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put
