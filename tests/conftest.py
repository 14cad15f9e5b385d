import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from shiftlens.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    found = session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    })
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
