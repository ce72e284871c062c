import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from orbitcart.session import get_session  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("orbitcart-tests", "local[4]", shuffle_partitions=4, extra={"spark.driver.memory": "8g"})
    yield s
