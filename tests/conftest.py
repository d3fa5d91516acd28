import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"}
    s = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(frame):
    """A pandas frame as sorted rows of text, columns by name."""
    def show(v):
        if v is None or str(v) == "<NA>" or v != v:
            return "NULL"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        return repr(float(v) + 0.0) if isinstance(v, (int, float)) or hasattr(v, "item") else str(v)
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(show(v) for v in r) for r in frame.astype(object).itertuples(index=False, name=None))
