from __future__ import annotations

import datetime
import decimal
import math
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[1]))
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    conf = {
        "spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false", "spark.default.parallelism": "4",
    }
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(x):
    """A value in the form in which Spark's and DuckDB's are compared."""
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat(sep=" ") if isinstance(x, datetime.datetime) else x.isoformat()
    return x


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)
