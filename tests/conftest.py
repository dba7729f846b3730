import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from headway.session import build_session

    s = build_session(
        "tests", "local[*]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def small_groups(spark):
    """Treat every key with more than a few rows as hot."""
    spark.conf.set("spark.headway.maxGroupRows", "7")
    yield
    spark.conf.unset("spark.headway.maxGroupRows")
