import json
import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from feedloom import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        app="tests", master="local[4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("tables")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def records(spark):
    """DataFrame (id, raw, v) of Python values or raw JSON texts."""
    from feedloom.sources.feeds import parsed

    def build(*values, partitions=None):
        rows = [(i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(values)]
        df = parsed(spark.createDataFrame(rows, "id int, raw string"))
        return df.repartition(partitions) if partitions else df

    return build
