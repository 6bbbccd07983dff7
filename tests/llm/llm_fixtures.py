"""Shared fixture of the training-data tests."""

import pytest


@pytest.fixture(scope="session")
def docs_pd(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
