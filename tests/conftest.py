import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gradewright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 4, "tests")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column function on one literal text."""
    from pyspark.sql import functions as F

    def value(function, text, ddl="string"):
        df = spark.createDataFrame([(text,)], f"x {ddl}")
        return df.select(function(F.col("x")).alias("y")).first()[0]

    return value
