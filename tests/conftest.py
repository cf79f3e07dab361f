import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tillstream.session import build_session  # noqa: E402
from tillstream.streaming.jobs import STATE_STORE  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("ckpt")),
        **STATE_STORE})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """frame("a int, d date", rows) with ISO text allowed for dates."""
    from pyspark.sql import functions as F

    def make(schema: str, rows):
        fields = [f.split() for f in schema.split(",")]
        text = ", ".join(f"{n} {'string' if t in ('date', 'timestamp') else t}" for n, t in fields)
        df = spark.createDataFrame(rows, text)
        return df.select(*[F.col(n).cast(t) for n, t in fields])
    return make
