"""Queries against their SQL over events that the given tables hold at larger sizes only."""

import datetime as dt

import duckdb

from tidemark.plans import registry

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
T0 = dt.datetime(2024, 1, 1)


def folder(spark, path, **tables):
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def events(spark, rows):
    """rows: (minutes from the start, user, type, value)."""
    at = lambda m: T0 + dt.timedelta(minutes=m)
    return spark.createDataFrame([(i, at(m), u, t, float(v), '{"k": 50}') for i, (m, u, t, v) in enumerate(rows)], EVENT)


def both(spark, path, name):
    """Rows of the query and of its SQL, columns and rows in order."""
    got = registry.QUERIES[name](spark, path)
    columns = sorted(got.columns)
    duck = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        if f"FROM {t}" in registry.ORACLE[name] or f"JOIN {t}" in registry.ORACLE[name]:
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")
    want = duck.execute(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} FROM ({registry.ORACLE[name]})").fetchall()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted(map(tuple, got.select(*columns).collect()), key=key), sorted(want, key=key)


def test_bars_that_open_at_nothing_have_a_direction(spark, tmp_path):
    rows = [(0, 1, "view", 0), (10, 1, "view", 5), (60, 1, "view", 0), (120, 1, "view", 4), (130, 1, "view", 1), (0, 2, "click", 3), (5, 2, "click", 0)]
    d = folder(spark, tmp_path / "t", events=events(spark, rows))
    got, want = both(spark, d, "interval_scaled_direction")
    assert got == want
    assert sorted(r[0] for r in got if r[1] == "60" and r[2] == "view") == ["DOWN", "UP", "UP"]


def test_entry_filter_takes_a_close_of_nothing(spark, tmp_path):
    rows = [(0, 1, "view", 900), (10, 1, "view", 200), (11, 1, "view", 0), (0, 2, "click", 2000), (5, 2, "click", 2000)]
    got, want = both(spark, folder(spark, tmp_path / "t", events=events(spark, rows)), "entry_filter")
    assert got == want and len(got) == 2


def test_a_day_after_a_close_of_nothing_has_no_return(spark, tmp_path):
    day = 1440
    rows = [(day * i, 1, "view", v) for i, v in enumerate([10, 0, 7, 8])] + [(day * i, 2, "view", v) for i, v in enumerate([3, 4, 5, 6])]
    got, want = both(spark, folder(spark, tmp_path / "t", events=events(spark, rows)), "benchmark_comparison")
    assert got == want and len(got) == 2


def test_a_curve_that_never_falls_has_no_sortino_ratio(spark, tmp_path):
    t = lambda *days: [T0 + dt.timedelta(days=n) for n in days]
    orders = spark.createDataFrame([(1, *t(0))], "o_orderkey long, o_orderdate timestamp_ntz")
    lines = [(1, x, "O", 1e6 * (i + 1), 0.05, 0.02) for i, x in enumerate(t(1, 2, 3, 4))]
    lines = spark.createDataFrame(lines, "l_orderkey long, l_shipdate timestamp_ntz, l_linestatus string, l_extendedprice double, l_discount double, l_tax double")
    got, want = both(spark, folder(spark, tmp_path / "t", orders=orders, lineitem=lines), "performance_report")
    assert got == want and len(got) == 1
    assert registry.QUERIES["performance_report"](spark, str(tmp_path / "t")).first()["sortino"] == 0


def test_many_symbols_are_counted_exactly(spark, tmp_path):
    got, want = both(spark, folder(spark, tmp_path / "t", events=events(spark, [(i % 7 * 1440 + i % 11, i % 6000, "view", 1) for i in range(12_000)])), "stored_coverage")
    assert got == want and 6000 in [r[-1] for r in got]


def test_equity_of_nothing_is_nothing(spark, tmp_path):
    """22 trades that win 27.8 and 478 that lose 22.2 use up the capital of 10 000 to the last cent, whatever the order of sums."""
    closes = [1000.0]
    for i in range(506):
        closes.append(closes[-1] * (1.0437 if i < 22 else 0.9563))
    e = events(spark, [(60 * i, 1, "view", v) for i, v in enumerate(closes)]).replace('{"k": 50}', '{"k": 99}', "props")
    d = folder(spark, tmp_path / "t", events=e)
    curve, _ = both(spark, d, "backtest_equity")
    assert [r[0] for r in curve if abs(r[0]) < 0.1] == [0.0]
    got, want = both(spark, d, "backtest_performance")
    assert got == want and len(got) == 1
    assert abs(registry.QUERIES["backtest_performance"](spark, d).first()["sharpe"]) < 20
