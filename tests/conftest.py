import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
# Python workers import the test modules their functions come from
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))

from reelspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, memory="4g", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def split_hot_keys(spark):
    """Treat every key of more than 200 rows as hot."""
    spark.conf.set("spark.reelspark.hotKeyRows", "200")
    yield
    spark.conf.unset("spark.reelspark.hotKeyRows")
