import pytest

from tamarack.session import get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "4")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s
