import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from grainmill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["small", "large"])
def route(request, spark):
    """Runs a test on the one-task route and on the cut-up route."""
    if request.param == "large":
        spark.conf.set("grainmill.broadcast.bytes", "0")
        spark.conf.set("grainmill.task.rows", "0")
    yield request.param
    spark.conf.unset("grainmill.broadcast.bytes")
    spark.conf.unset("grainmill.task.rows")
