import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    own = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(own / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{own}/shared")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same_rows(mine, oracle):
    """Equal columns and rows in any order; doubles to 12 digits."""
    import pandas as pd

    cols = sorted(mine.columns)
    assert cols == sorted(oracle.columns)
    a, b = (x[cols].sort_values(cols, ignore_index=True) for x in (mine, oracle))
    for c in cols:
        if a[c].dtype.kind in "iu" or b[c].dtype.kind in "iu":
            a[c], b[c] = a[c].astype("Int64"), b[c].astype("Int64")
        if a[c].dtype.kind == "M":
            a[c], b[c] = a[c].astype("datetime64[us]"), b[c].astype("datetime64[us]")
    pd.testing.assert_frame_equal(a.convert_dtypes(), b.convert_dtypes(), check_dtype=False, rtol=1e-12)
