import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent.parent))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/sf0.001/{t}.parquet')")
    return c


def plain(x):
    import pandas as pd

    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    return round(x, 5) + 0.0 if isinstance(x, float) else x


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def same():
    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        assert rows(a) == rows(b)

    return check
