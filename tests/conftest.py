import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from support import TESTDATA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the tables of the smallest scale as views."""
    duckdb = pytest.importorskip("duckdb")
    folder = TESTDATA / "sf0.001"
    if not folder.exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con
