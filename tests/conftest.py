import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from revlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="revlens-tests-")
    session = build_session(
        "local[8]", "tests",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
           "spark.checkpoint.dir": folder, "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluates a column function on inline text values."""

    def evaluate(values, build, schema="x string"):
        rows = [v if isinstance(v, tuple) else (v,) for v in values]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
        return [r.out for r in df.select("i", build(df).alias("out")).orderBy("i").collect()]

    return evaluate
