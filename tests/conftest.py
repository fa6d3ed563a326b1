import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from firn.session import release, session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session(
        "firn-tests",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    release(made)
    made.stop()
