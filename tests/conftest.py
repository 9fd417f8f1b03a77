import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from storyhub.session import local_session, prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = prepare(local_session(8, "storyhub-tests"))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column over one row of named values."""

    def run(column, **values):
        from pyspark.sql import functions as F

        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
        return df.select(column.alias("out")).first()["out"]

    return run
