import os

import pytest


@pytest.fixture(scope="session", autouse=True)
def code_shipped(spark):
    from llm.shipping import ship

    ship(spark)


@pytest.fixture
def table(spark):
    """Documents from (doc_id, text) pairs, with an extra column whose name clashes with inner ones."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, rep string")

    return make
