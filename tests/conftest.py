import os
import sys
from pathlib import Path

import pytest

REPO = str(Path(__file__).resolve().parents[1])
os.environ["PYTHONPATH"] = f"{REPO}:{os.environ.get('PYTHONPATH', '')}"
sys.path.insert(0, REPO)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(shared)}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for f in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _cell(x):
    """Nulls are alike, and whole numbers whether a column with nulls made floats of them or not."""
    if str(x) in ("None", "nan", "<NA>", "NaT"):
        return "null"
    if isinstance(x, float):
        return str(int(x)) if x.is_integer() else repr(round(x, 9))
    return str(x)


@pytest.fixture(scope="session")
def rows_of():
    """A pandas frame as sorted column names and sorted rows."""

    def run(frame):
        names = sorted(frame.columns)
        return names, sorted(tuple(map(_cell, r)) for r in frame[names].astype(object).itertuples(index=False))

    return run
