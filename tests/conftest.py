import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from censora.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="4", shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """``frame("a int, b string", (1, "x"), …)`` → DataFrame."""

    def make(schema, *rows):
        return spark.createDataFrame([tuple(r) for r in rows], schema)

    return make


@pytest.fixture
def many_tasks(spark):
    """Small test data would be merged into one task; keep the planned partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def rows(df, *order):
    """Rows as tuples, sorted by the given columns or by themselves."""
    got = [tuple(r) for r in df.collect()]
    if order:
        names = df.columns
        return sorted(got, key=lambda r: tuple(str(r[names.index(c)]) for c in order))
    return sorted(got, key=lambda r: tuple((v is None, str(v)) for v in r))
