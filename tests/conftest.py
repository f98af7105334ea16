import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from envspark.session import drop_tables, get_session
    s = get_session("local[2]", app="envspark-tests", conf={
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield s
    drop_tables(s)
    s.stop()
