import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(TOP), str(TOP / "tests")]


@pytest.fixture(scope="session")
def spark():
    from copyloom.session import session, ship

    s = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s
