import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from parcelflow.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def column(spark):
    """Values of an expression over one column of literal values, in their order."""

    def evaluate(values, kind, expression):
        rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
        return [r[0] for r in rows.orderBy("i").select(expression.alias("y")).collect()]

    return evaluate
