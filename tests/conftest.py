import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tidings.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def apply(spark):
    """Evaluate a column function over inline values and return the results in order."""

    def run(function, values, schema="v string"):
        width = len(schema.split(","))
        rows = [(i, *(v if width > 1 else (v,))) for i, v in enumerate(values)]
        frame = spark.createDataFrame(rows, f"i int, {schema}")
        names = frame.columns[1:]
        out = frame.select("i", function(*[frame[n] for n in names]).alias("out"))
        return [r["out"] for r in sorted(out.collect(), key=lambda r: r["i"])]

    return run


SF_SMALL = "/root/testdata/sf0.001"
