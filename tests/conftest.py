import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from checks.compare import session

    where = tmp_path_factory.mktemp("spark")
    return session(8, **{"spark.sql.warehouse.dir": f"file://{where}/warehouse", "spark.checkpoint.dir": f"file://{where}/checkpoint"})


@pytest.fixture(scope="session")
def logs(spark):
    """The stored click table of the small tables."""
    from checks import derive

    return derive.stored(spark, SMALL)


@pytest.fixture(scope="session")
def logs_list(logs):
    return logs.collect()
