import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def walk(spark):
    """500 hourly candles of a seeded random walk for each of three symbols, at different scales."""
    import datetime as dt

    import numpy as np

    rows = []
    for symbol, scale, seed in (("AAA", 1.0, 42), ("BBB", 0.05, 43), ("CCC", 0.001, 44)):
        rng = np.random.default_rng(seed)
        close = 100 * scale * np.cumprod(1 + rng.normal(0.0001, 0.02, 500))
        start = np.concatenate(([100 * scale], close[:-1]))
        high = np.maximum(start, close) * (1 + abs(rng.normal(0, 0.005, 500)))
        low = np.minimum(start, close) * (1 - abs(rng.normal(0, 0.005, 500)))
        volume = abs(rng.normal(1e6, 3e5, 500))
        for i in range(500):
            rows.append((symbol, "60", dt.datetime(2025, 1, 1) + dt.timedelta(hours=i), *map(float, (start[i], high[i], low[i], close[i], volume[i]))))
    df = spark.createDataFrame(rows, "symbol string, interval string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    return df.cache()
