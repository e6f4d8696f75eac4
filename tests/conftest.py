import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from checks.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cpus=4, partitions=4)


@pytest.fixture(scope="session")
def one(spark):
    """Value(s) of columns built over one row of named string inputs."""
    def run(columns, **values):
        df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
        row = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
        return list(row)
    return run


@pytest.fixture(scope="session")
def each(spark):
    """Results of one column function over many inputs."""
    def run(fn, inputs):
        rows = [(i, v) for i, v in enumerate(inputs)]
        df = spark.createDataFrame(rows, "i int, v string")
        return [r["o"] for r in df.select("i", fn(df["v"]).alias("o")).orderBy("i").collect()]
    return run
