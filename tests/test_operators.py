"""Properties of the operators on hand-made and random-walk candles."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.recursive import Smooth, ema, smooth
from tidemark.operators import backtest, dataset, ensemble, indicators, joins, monitor, quality, regime, risk, scoring
from tidemark.sources import payloads, store

BAR = "symbol string, interval string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
T0 = dt.datetime(2025, 1, 1)


def bars(spark, closes, symbol="A", minutes=60, **other):
    rows = []
    for i, c in enumerate(closes):
        rows.append((symbol, str(minutes), T0 + dt.timedelta(minutes=minutes * i), c, other.get("high", [c] * len(closes))[i], other.get("low", [c] * len(closes))[i], c, other.get("volume", [1.0] * len(closes))[i]))
    return spark.createDataFrame(rows, BAR)


def test_rejections(spark):
    b = bars(spark, [100.0, 100.0, -1.0, 100.0, 101.0], high=[101.0, 98.0, 1.0, 101.0, 102.0], low=[99.0, 99.0, -2.0, 99.0, 100.0], volume=[1.0, 1.0, 1.0, -1.0, 1.0])
    assert [r["reject_reason"] for r in quality.validated(b).orderBy("ts").collect()] == [None, "range", "close", "volume", None]


def test_jump_is_flagged_and_kept(spark):
    assert [r["is_jump"] for r in quality.jumps(bars(spark, [100.0, 200.0, 210.0])).orderBy("ts").collect()] == [False, True, False]


def test_one_gap_of_four_hours(spark):
    b = bars(spark, [1.0] * 8).where(~F.hour("ts").isin(3, 4, 5))
    assert [(r["minutes"]) for r in quality.gaps(b).collect()] == [240]
    assert quality.gaps(bars(spark, [1.0] * 8, minutes=15)).count() == 0


def test_training_gate(spark):
    few, none = bars(spark, [1.0] * 10, "FEW"), bars(spark, [1.0] * 120, "NONE", volume=[0.0] * 120)
    got = {r["symbol"]: r["kept"] for r in quality.training_gate(few.union(none).union(bars(spark, [1.0] * 120))).collect()}
    assert got == {"FEW": False, "NONE": False, "A": True}


def test_indicators_are_complete_bounded_and_scale_free(walk):
    out = indicators.compute(walk)
    assert len(indicators.NAMES) == len(set(indicators.NAMES)) == 41 and set(indicators.NAMES) <= set(out.columns)
    p = out.toPandas().sort_values(["symbol", "ts"])
    late = p[p.groupby("symbol").cumcount() > indicators.WARMUP]
    assert not late[indicators.NAMES].isna().any().any()
    assert late["rsi_14"].between(0, 100).all() and late["williams_r"].between(-100, 0).all() and late["stoch_rsi_k"].between(0, 1).all() and (late["adx"] >= 0).all()
    big = walk.where("symbol = 'AAA'").withColumns({c: F.col(c) * 1000 for c in ("open", "high", "low", "close")})
    a = p[p.symbol == "AAA"][indicators.NAMES].to_numpy(float)
    b = indicators.compute(big).toPandas().sort_values("ts")[indicators.NAMES].to_numpy(float)
    assert np.allclose(a[170:], b[170:], rtol=1e-6, atol=1e-8)


@pytest.mark.parametrize("rows", [60, 150, None])
def test_smoothing_in_blocks_is_the_plain_recursion(walk, rows):
    x = walk.withColumn("late", F.when(F.col("ts") >= F.lit("2025-01-03").cast("timestamp_ntz"), F.col("volume")))
    got = smooth(x, [ema("close", "e", 21), Smooth("late", "w", 1 / 14, 5)], rows=rows).toPandas().sort_values(["symbol", "ts"])
    for _, g in got.groupby("symbol"):
        want = g["close"].ewm(span=21, adjust=False, min_periods=21).mean()
        assert np.allclose(g["e"].astype(float), want, rtol=1e-10, equal_nan=True)
        want = g["late"].ewm(alpha=1 / 14, adjust=False, min_periods=5).mean()
        assert np.allclose(g["w"].astype(float), want, rtol=1e-10, equal_nan=True)


def test_wilder_average_starts_with_the_mean(walk):
    got = indicators.trend(walk.where("symbol = 'AAA'")).toPandas().sort_values("ts")
    pc = got["close"].shift()
    tr = pd.concat([got["high"] - got["low"], (got["high"] - pc).abs(), (got["low"] - pc).abs()], axis=1).max(axis=1).to_numpy()
    want = [math.nan] * 13 + [tr[:14].mean()]
    for x in tr[14:]:
        want.append((want[-1] * 13 + x) / 14)
    assert np.allclose(got["atr"].astype(float), want, equal_nan=True)


def test_direction_boundaries(spark):
    xs = [0.0051, 0.005, -0.005, -0.0051, 0.0]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(C.direction("x", 0.005)).collect()
    assert [r[0] for r in got] == ["UP", "FLAT", "FLAT", "DOWN", "FLAT"]


def test_conviction_of_sure_and_uniform(spark):
    df = spark.createDataFrame([(0.95, 0.025, 0.025), (1 / 3, 1 / 3, 1 / 3), (1.0, 0.0, 0.0)], "prob_up double, prob_flat double, prob_down double")
    got = [r[0] for r in df.select(C.conviction("prob_up", "prob_flat", "prob_down")).collect()]
    assert got[0] > 0.7 and got[1] < 0.05 and got[2] == pytest.approx(1.0)


def test_as_of_takes_the_latest_not_the_future(spark):
    b = bars(spark, [1.0, 2.0, 3.0])
    side = spark.createDataFrame([("A", T0 + dt.timedelta(minutes=m), float(m)) for m in (10, 60, 61)], "symbol string, ts timestamp_ntz, v double")
    assert [r["v"] for r in joins.as_of(b, side, ["v"]).orderBy("ts").collect()] == [None, 60.0, 61.0]
    assert [r["v"] for r in joins.as_of(b, side, ["v"], max_age_minutes=30, fills={"v": 0.0}).orderBy("ts").collect()] == [0.0, 60.0, 0.0]


def test_outcomes(spark):
    b = bars(spark, [100.0, 102.0, 100.0])
    p = b.select("symbol", "interval", "ts", F.lit("UP").alias("direction"))
    got = joins.outcomes(p, b).orderBy("ts").collect()
    assert [r["was_correct"] for r in got] == [True, False, None] and got[2]["scored_at"] is None
    assert scoring.unscored(joins.outcomes(p, b)).count() == 1


def test_windows_never_cross_symbols_and_are_normalised(walk):
    x = dataset.normalized(dataset.windows(dataset.labelled(walk, 1, 0.005), ["close", "volume"], 24, stride=50)).collect()
    assert x and all(r["label"] in (0, 1, 2) and len(r["window"]) == 24 for r in x)
    for r in x:
        w = np.array(r["window"])
        assert np.allclose(w.mean(axis=0), 0, atol=1e-9) and np.allclose(w.std(axis=0), 1)


def test_labels_follow_the_threshold(walk):
    flat = [dataset.labelled(walk, 1, t).where("label = 1").count() for t in (0.001, 0.005, 0.05)]
    assert flat == sorted(flat) and flat[0] < flat[2]


def test_blend_sums_to_one_and_conflicts_shrink(spark):
    cols = "symbol string, ts int, at int, prob_up double, prob_flat double, prob_down double, magnitude double, direction string"
    a = spark.createDataFrame([("A", 1, 1, 0.7, 0.1, 0.2, 0.03, "UP"), ("B", 1, 1, 0.7, 0.1, 0.2, 0.03, "UP"), ("C", 1, 1, 0.7, 0.1, 0.2, 0.03, "UP")], cols)
    b = spark.createDataFrame([("A", 1, 1, 0.1, 0.1, 0.8, 0.1, "DOWN"), ("A", 1, 2, 0.7, 0.1, 0.2, 0.03, "UP"), ("B", 1, 1, 0.1, 0.1, 0.8, -0.03, "DOWN")], cols)
    got = {r["symbol"]: r for r in ensemble.combine_timeframes(a, b).collect()}
    assert set(got) == {"A", "B"} and got["A"]["agreement"] == "STRONG" and got["B"]["agreement"] == "CONFLICT" and got["A"]["score"] > got["B"]["score"]
    assert all(r["prob_up"] + r["prob_flat"] + r["prob_down"] == pytest.approx(1) for r in got.values())


def test_agreement_of_every_pair_of_directions(spark):
    # (a, b, size of a's move, of b's) and what they are called; exactly 1 % isn't small
    cases = [
        ("UP", "UP", 0.001, 0.001, "STRONG", "STRONG UP"), ("DOWN", "DOWN", 0.02, 0.02, "STRONG", "STRONG DOWN"), ("FLAT", "FLAT", 0.0, 0.0, "PARTIAL", "BOTH FLAT"),
        ("DOWN", "FLAT", 0.02, 0.0, "PARTIAL", "WEAK DOWN"), ("FLAT", "UP", 0.0, 0.02, "PARTIAL", "TIMING UP"), ("UP", "DOWN", 0.02, -0.005, "PARTIAL", "PULLBACK UP"),
        ("UP", "DOWN", 0.005, -0.02, "PARTIAL", "TIMING DOWN"), ("UP", "DOWN", 0.005, -0.005, "CONFLICT", "CONFLICT"), ("DOWN", "UP", -0.02, 0.02, "CONFLICT", "CONFLICT"), ("UP", "DOWN", 0.01, -0.01, "CONFLICT", "CONFLICT"),
    ]
    df = spark.createDataFrame(cases, "a string, b string, x double, y double, class string, label string").withColumn("got", ensemble.agreement_label("a", "b", "x", "y"))
    for r in df.withColumn("kind", ensemble.agreement(F.col("got"))).collect():
        assert (r["kind"], r["got"]) == (r["class"], r["label"]), r


def test_single_model_passes_through_and_uncertainties_add(spark):
    cols = "symbol string, interval string, ts int, model string, prob_up double, prob_flat double, prob_down double, magnitude double, uncertainty double"
    rows = [("A", "60", 1, "m", 0.6, 0.3, 0.2, 0.01, 0.25), ("B", "60", 1, "m", 0.5, 0.3, 0.2, 0.01, 0.2), ("B", "60", 1, "n", 0.7, 0.1, 0.2, 0.03, 0.4)]
    got = {r["symbol"]: r for r in ensemble.combine_models(spark.createDataFrame(rows, cols)).collect()}
    assert (got["A"]["prob_up"], got["A"]["uncertainty"], got["A"]["agreement"]) == (0.6, 0.25, 1.0)
    assert got["B"]["uncertainty"] == pytest.approx((0.1 + 0.1 + 0.0) / 3 + 0.3)


def test_calibration_leaves_certain_rows_out(spark):
    from tidemark.operators import monitor

    df = spark.createDataFrame([(1.0, 0.0, 0.0, False)] * 5 + [(0.95, 0.05, 0.0, True)] * 5, "prob_up double, prob_flat double, prob_down double, was_correct boolean")
    got = monitor.calibration(df).collect()[0]
    assert got["n"] == 5 and got["ece"] == pytest.approx(0.05)
    assert monitor.calibration(df.limit(0)).collect()[0]["ece"] == 0


def test_simulated_equity_grows_by_the_predicted_move(spark):
    rows = [(i, "A", "UP" if i < 3 else "FLAT", 0.1, 9.0, i % 2 == 0) for i in range(5)] + [(9, "A", "DOWN", None, 1.0, True)]
    df = spark.createDataFrame(rows, "scored_at int, symbol string, direction string, magnitude double, actual_magnitude double, was_correct boolean")
    assert scoring.simulated_equity(df).collect()[0]["equity"] == pytest.approx(10_000 * 1.1 * 0.95 * 1.1)
    assert scoring.simulated_equity(df, n=1).collect()[0]["equity"] == 10_000
    assert scoring.simulated_equity(df.limit(0)).collect()[0]["equity"] == 10_000


def test_drawdown_machine():
    m = risk.Drawdown(ramp=4)
    got = [m.update(x) for x in (0, 100, 94, 96, 89, 90, 93.5, 94, 94, 96, 91, 89, 120)]
    assert [g[0] for g in got] == ["NORMAL", "NORMAL", "REDUCED", "NORMAL", "HALTED", "HALTED", "RECOVERING", "RECOVERING", "RECOVERING", "NORMAL", "REDUCED", "HALTED", "RECOVERING"]
    # the size grows from the reduced one while recovering; the peak stays
    assert [g[2] for g in got[6:9]] == [0.5, 0.625, 0.75] and got[4][2] == 0 and got[8][1] == pytest.approx(0.06)


def test_fine_bars_smooth_without_overflow(spark):
    rng = np.random.default_rng(1)
    close = 100 * np.cumprod(1 + rng.normal(0, 0.001, 6000))
    got = indicators.trend(bars(spark, [float(x) for x in close], minutes=1)).toPandas().sort_values("ts")
    for n in (9, 21, 50):
        assert np.allclose(got[f"ema_{n}"].astype(float), pd.Series(close).ewm(span=n, adjust=False, min_periods=n).mean(), rtol=1e-12, equal_nan=True)
    assert np.isfinite(got["macd"].astype(float)[200:]).all()


def test_samples_of_heavy_rows_are_all_drawn(spark):
    rows = bars(spark, [1.0] * 200).withColumn("weight", F.when(F.col("ts") == F.lit(T0).cast("timestamp_ntz"), 1000.0).otherwise(1.0))
    got = dataset.weighted_sample(rows).collect()
    mean = 1000 / (1199 / 200)
    assert abs(next(r["draws"] for r in got if r["weight"] > 1) - mean) < 5 * mean**0.5
    assert sorted(map(str, got)) == sorted(map(str, dataset.weighted_sample(rows.repartition(5)).collect()))


def test_draws_are_poisson(spark):
    rows = spark.range(20_000).select(F.lit("A").alias("symbol"), F.when(F.col("id") % 2 == 0, "x").alias("interval"), F.col("id").alias("ts"), F.when(F.col("id") < 10, 0.0).when(F.col("id") < 5_000, 3.0).otherwise(1.0).alias("weight"))
    mean = rows.agg(F.avg("weight")).first()[0]
    got = dataset.weighted_sample(rows).toPandas().set_index("ts")["draws"].reindex(range(20_000), fill_value=0)
    assert (got[:10] == 0).all() and abs(got.sum() / 20_000 - 1) < 0.03
    for part, lam in ((got[10:5_000], 3 / mean), (got[5_000:], 1 / mean)):
        assert abs(part.mean() / lam - 1) < 0.05 and abs(part.var() / lam - 1) < 0.08
        assert abs((part == 0).mean() - np.exp(-lam)) < 0.02
    big = spark.range(3_000).select(dataset.poisson(F.lit(1234.5), lambda i: F.concat_ws("|", i.cast("string"), F.col("id").cast("string"))).alias("n")).toPandas()["n"]
    assert abs(big.mean() / 1234.5 - 1) < 0.01 and abs(big.var() / 1234.5 - 1) < 0.15
    odd = bars(spark, [1.0] * 3).withColumn("weight", F.lit(None).cast("double"))
    assert dataset.weighted_sample(odd).collect() == []


def test_pairs_use_their_own_tails(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=60)
    rows = [(s, T0 + dt.timedelta(hours=60 - i), float(v)) for s, n, k in (("A", 60, 1.0), ("B", 60, -2.0), ("C", 30, 3.0)) for i, v in enumerate(k * x[:n])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ret double")
    own = {(r["a"], r["b"]): r for r in joins.pair_correlations(df, tail="pair", block=16).collect()}
    assert own["A", "B"]["points"] == 60 and own["A", "C"]["points"] == 30 and own["A", "B"]["r"] == pytest.approx(-1) and own["A", "C"]["r"] == pytest.approx(1)
    assert {r["points"] for r in joins.pair_correlations(df, block=16).collect()} == {30} and len(own) == 6


def test_fewer_symbols_than_clusters_are_one_cluster(walk):
    from tidemark.operators import ml

    stats = ml.symbol_statistics(walk.withColumn("ret", C.pct("close")))
    assert {r["cluster"] for r in ml.clusters(stats, 5).collect()} == {0} and len({r["cluster"] for r in ml.clusters(stats, 2).collect()}) == 2


def test_stored_imbalance_and_windows_without_liquidations(spark):
    from tidemark.operators import side_features

    b = spark.createDataFrame([("A", T0, [1.0], [1.0], 1.0, 2.0, 0.9)], "symbol string, ts timestamp_ntz, bid_vols array<double>, ask_vols array<double>, spread double, mid_price double, imbalance double")
    assert side_features.orderbook(b).collect()[0]["ob_imbalance"] == 0.9 and side_features.orderbook(b.drop("imbalance")).collect()[0]["ob_imbalance"] == 0.5
    d = spark.createDataFrame([("A", T0 + dt.timedelta(hours=i), 1.0, 0.0, 0.0, 1.0) for i in range(30)], "symbol string, ts timestamp_ntz, oi_close double, long_vol double, short_vol double, ratio double")
    got = side_features.derivatives(d).orderBy("ts").collect()
    assert got[0]["liq_spike"] is None and got[29]["liq_spike"] == pytest.approx(1.0)


def test_intermediate_tables_need_a_shared_folder():
    from types import SimpleNamespace

    from tidemark.session import shared_folder

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))

    assert shared_folder(session("spark://m:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_folder(session("local[4]")) == shared_folder(session("local[4]"))
    for master in ("spark://m:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            shared_folder(session(master))


def test_sides_are_carried_together(spark):
    b = bars(spark, [1.0, 2.0, 3.0])
    one = spark.createDataFrame([("A", T0 + dt.timedelta(minutes=m), float(m)) for m in (-3000, 10, 60)], "symbol string, ts timestamp_ntz, v double")
    two = spark.createDataFrame([("A", T0 + dt.timedelta(minutes=120), 7.0), ("A", T0 + dt.timedelta(minutes=60), 6.0), ("A", T0 + dt.timedelta(minutes=60), 5.0)], "symbol string, ts timestamp_ntz, w double")
    got = joins.as_of_all(b, [joins.Side(one, ["v"]), joins.Side(two, ["w"], 0, {"w": 0.0})]).orderBy("ts").collect()
    assert [(r["v"], r["w"]) for r in got] == [(-3000.0, 0.0), (60.0, 6.0), (60.0, 7.0)]


def test_stop_comes_before_target_and_entry_bar_is_not_checked(spark):
    b = bars(spark, [100.0, 100.0, 100.0, 100.0], high=[200.0, 100.0, 104.0, 100.0], low=[1.0, 100.0, 97.0, 100.0])
    e = b.limit(1).select("symbol", "interval", "ts", F.lit("LONG").alias("action"))
    r = backtest.exits(b, e).collect()[0]
    assert (r["exit_reason"], r["exit_price"], r["bars_held"]) == ("stop_loss", 98.0, 2)
    assert backtest.exits(b.where("ts < timestamp_ntz'2025-01-01 02:00:00'"), e).collect()[0]["exit_reason"] == "end_of_backtest"


def test_trades_do_not_overlap(spark):
    rows = [("A", "60", T0 + dt.timedelta(hours=a), T0 + dt.timedelta(hours=b)) for a, b in ((0, 5), (1, 3), (5, 6), (5, 9), (7, 8))]
    got = backtest.one_at_a_time(spark.createDataFrame(rows, "symbol string, interval string, ts timestamp_ntz, exit_ts timestamp_ntz")).orderBy("ts").collect()
    assert [(r["ts"].hour, r["exit_ts"].hour) for r in got] == [(0, 5), (5, 6), (7, 8)]


def test_equity_marks_open_trades(spark):
    b = bars(spark, [100.0, 110.0, 120.0, 130.0])
    t = spark.createDataFrame([("A", "60", T0, "LONG", 100.0, T0 + dt.timedelta(hours=3), 130.0)], "symbol string, interval string, ts timestamp_ntz, action string, entry_price double, exit_ts timestamp_ntz, exit_price double")
    got = backtest.equity_curve(backtest.profit(t), b).orderBy("ts").collect()
    assert [round(r["equity"], 6) for r in got] == [10000.0, 10100.0, 10200.0, 10000 + 300 - 2.2]


def test_store_first_and_last_write(spark, tmp_path):
    b = bars(spark, [1.0, 2.0]).withColumn("arrival", F.lit(0))
    again = b.withColumns({"close": F.col("close") + 10, "arrival": F.lit(1)})
    key = ["symbol", "interval", "ts"]
    path = str(tmp_path / "t")
    assert store.append_new(b.union(again), path, key, ["interval"], "arrival") == 2
    assert store.append_new(again.union(bars(spark, [5.0] * 3).withColumn("arrival", F.lit(2))), path, key, ["interval"], "arrival") == 1
    assert sorted(r["close"] for r in spark.read.parquet(path).collect()) == [1.0, 2.0, 5.0]
    assert sorted(r["close"] for r in store.upserted(b, again, key, "arrival").collect()) == [11.0, 12.0]


def test_bad_payload_items_are_skipped(spark):
    text = '{"data":[{"time":"1735689600000","open":"1","high":"2","low":"0.5","close":"1.5"},{"time":"x","open":"1","high":"2","low":"1","close":"1"},{"time":"1735693200000","open":"bad","high":"2","low":"1","close":"1"}]}'
    raw = spark.createDataFrame([("A", "60", text), ("B", "60", "not json"), ("C", "60", None)], "symbol string, interval string, payload string")
    got = payloads.klines(raw).collect()
    assert len(got) == 1 and got[0]["volume"] == 0.0 and got[0]["ts"] == T0
    books = spark.createDataFrame([("A", '{"ts":1735689600000,"bids":[{"price":"1","volume":"3"}],"asks":[{"price":"2","volume":"1"}]}'), ("B", '{"ts":1,"bids":[],"asks":[["1","1"]]}')], "symbol string, payload string")
    got = payloads.depth(books).collect()
    assert len(got) == 1 and got[0]["imbalance"] == 0.75 and got[0]["mid_price"] == 1.5


def test_number_lists(spark):
    df = spark.createDataFrame([("[1, 2.5, null]",), ("3",), ("x",), (None,), ("[]",)], "t string")
    assert [r[0] for r in df.select(C.number_list_sum("t")).collect()] == [3.5, 3.0, 0.0, 0.0, 0.0]


def test_regime_names_overwrite_in_order(spark):
    df = spark.createDataFrame([(0, 0.5, 0.9), (1, 0.1, 0.1), (2, 0.1, -0.3), (3, 0.2, 0.0)], "state int, vol24 double, ret1 double")
    assert [r["regime"] for r in regime.named(df).orderBy("state").collect()] == ["UP", "RANGING", "DOWN", "RANGING"]


def test_windows_in_pieces_are_the_whole_windows(walk):
    from tidemark.functions import chunks

    whole = indicators.momentum(walk).orderBy("symbol", "ts").toPandas()
    parts = chunks.in_pieces(walk, indicators.momentum, indicators.WARMUP, size=170, bucket="5 hours").orderBy("symbol", "ts").toPandas()
    assert len(whole) == len(parts) and set(parts["interval"]) == {"60"}
    for c in ("price_position_168", "pct_change_168", "williams_r"):
        assert np.allclose(whole[c].astype(float), parts[c].astype(float), equal_nan=True), c


def test_feature_list_has_66_names():
    from tidemark.operators.side_features import feature_columns

    names = feature_columns()
    assert len(names) == len(set(names)) == 66
    # shapes, crosses and band distances come before places in the range
    assert names[28:41] == [
        "pct_change_168", "candle_body_ratio", "upper_wick_ratio", "lower_wick_ratio", "ema_9_21_cross", "ema_21_50_cross", "price_vs_bb_upper", "price_vs_bb_lower",
        "price_position_48", "price_position_168", "momentum_accel", "atr_expansion", "vol_price_ratio",
    ]


def test_foreign_model_is_loaded_once_a_worker(walk, tmp_path):
    from tidemark.operators.ml import score_with

    log = tmp_path / "loads"

    def load():
        with log.open("a") as f:
            f.write("x")
        return lambda x: pd.DataFrame({"up": (x["close"] > x["open"]).astype(float), "gap": x["close"] - x["open"]})

    rows = walk.repartition(12).withColumn("open", F.when(F.col("open") > 0, F.col("open")))
    got = score_with(rows, ["close", "open"], load, "up double, gap double", batch=10).collect()
    assert len(got) == 1500 and all(r["up"] == float(r["close"] > r["open"]) and r["gap"] == r["close"] - r["open"] for r in got)
    assert 1 <= len(log.read_text()) <= 4, "a load a worker, of 12 tasks and 150 batches"


def chained(rows):
    """Of each series' trades in time order, the first and then each that begins when the one before it is over."""
    kept, free = [], {}
    for r in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        if r[0] not in free or r[1] >= free[r[0]]:
            kept.append(r)
            free[r[0]] = r[2]
    return kept


def test_long_chains_of_trades(spark, monkeypatch):
    import random

    rng, rows = random.Random(2), []
    for k, n, gap, hold in (("a", 700, 1, 24), ("b", 90, 5, 3), (None, 60, 2, 9), ("c", 50, 1, 200), ("d", 80, 1, 1), ("e", 1, 1, 1)):
        t = 0
        for _ in range(n):
            t += rng.randrange(1, gap + 1)
            rows.append((k, T0 + dt.timedelta(minutes=t), T0 + dt.timedelta(minutes=t + rng.randrange(1, hold + 1))))
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, exit_ts timestamp_ntz").withColumn("interval", F.lit("1")).repartition(4)
    order = lambda x: sorted(map(tuple, x), key=lambda r: (r[0] or "", r[1], r[2]))
    for block in (1024, 16):
        monkeypatch.setattr(backtest, "BLOCK", block)
        assert order(backtest.one_at_a_time(frame).select("symbol", "ts", "exit_ts").collect()) == order(chained(rows))


def test_hard_trades(spark):
    hours = lambda *x: [None if h is None else T0 + dt.timedelta(hours=h) for h in x]
    rows = [("A", *hours(0, 0)), ("A", *hours(0, 0)), ("A", *hours(1, None)), ("A", *hours(2, 3)), ("B", *hours(None, 3)), ("B", *hours(4, 4)), ("B", *hours(4, 6)), ("B", *hours(5, 7))]
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, exit_ts timestamp_ntz")
    got = backtest.one_at_a_time(frame, ["symbol"]).collect()
    assert sorted((r.symbol, r.ts.hour, r.exit_ts and r.exit_ts.hour) for r in got if r.exit_ts) == [("A", 0, 0), ("A", 0, 0), ("B", 4, 4), ("B", 4, 6)]
    assert [(r.symbol, r.ts.hour) for r in got if not r.exit_ts] == [("A", 1)]
    assert backtest.one_at_a_time(frame.where("false"), ["symbol"]).collect() == []


def test_first_opposite_signal_reverses(spark):
    b = bars(spark, [100.0] * 8)
    times = [r.ts for r in b.orderBy("ts").collect()]
    e = spark.createDataFrame([("A", "60", times[i], a) for i, a in ((0, "LONG"), (1, "LONG"), (3, "SHORT"), (6, "LONG"), (7, "SHORT"))], "symbol string, interval string, ts timestamp_ntz, action string")
    got = {r.ts.hour: (r.exit_ts.hour, r.exit_reason, r.bars_held, len(r.path)) for r in backtest.exits(b, e, reverse=True).collect()}
    assert got == {0: (3, "reversal", 3, 2), 1: (3, "reversal", 2, 1), 3: (6, "reversal", 3, 2), 6: (7, "reversal", 1, 0)}
    assert backtest.exits(b, e, hold=3).where("exit_reason = 'time'").count() == 3
    t = backtest.profit(backtest.one_at_a_time(backtest.exits(b, e, reverse=True)))
    own, other = (backtest.equity_curve(x, b).orderBy("ts").collect() for x in (t, t.drop("path")))
    assert own == other and len(own) == 8


def test_annual_return_spans_all_points(spark):
    curve = spark.createDataFrame([("x", T0 + dt.timedelta(hours=i), v) for i, v in enumerate((100.0, 120.0, 90.0, 110.0))], "run string, ts timestamp_ntz, equity double")
    r = backtest.performance(curve, ["run"], 8.0).first()
    assert r.periods == 4 and r.annual_return == pytest.approx(1.1 ** (8 / 4) - 1) and r.calmar == pytest.approx((1.1**2 - 1) / 0.25)


def test_running_totals_in_two_levels(spark, walk):
    from tidemark.functions import chunks

    rows = walk.withColumn("v", F.when(F.hour("ts") != 3, F.col("volume"))).withColumn("w", F.lit(None).cast("double"))
    got = chunks.running_totals(rows, {"total": "v", "none": "w"}, "7 hours").orderBy("symbol", "ts").toPandas()
    for _, g in got.groupby("symbol"):
        assert np.allclose(g["total"], g["v"].fillna(0).cumsum()) and g["none"].isna().all()
    plan = chunks.running_totals(rows, {"total": "v"}, "7 hours")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(symbol" in plan and all("_b" in w.split(",")[2] for w in plan.split("windowspecdefinition(")[1:] if "ts#" in w.split(")")[0])
    late = spark.createDataFrame([(None, "60", T0, 2.0), (None, "60", T0 + dt.timedelta(days=2), 3.0), ("A", "60", None, 5.0)], "symbol string, interval string, ts timestamp_ntz, v double")
    assert sorted(r["t"] for r in chunks.running_totals(late, {"t": "v"}).collect()) == [2.0, 5.0, 5.0]


def test_volume_in_pieces_is_the_whole(walk):
    whole = indicators.volume(walk).orderBy("symbol", "ts").toPandas()
    parts = indicators.volume_in_pieces(walk, size=60, bucket="9 hours").orderBy("symbol", "ts").toPandas()
    assert list(whole.columns) == list(parts.columns) and len(whole) == len(parts)
    for c in ("obv_roc", "acc_dist_roc", "vol_sma_ratio", "vol_z_score", "vwap", "vol_price_ratio"):
        assert np.allclose(whole[c].astype(float), parts[c].astype(float), equal_nan=True), c


def test_drawdown_machine_streams_long_curves(spark):
    n = 40_000
    value = 100 + 30 * F.sin(F.col("id") / 700) + 12 * F.sin(F.col("id") / 11)
    curve = spark.range(n).select(F.when(F.col("id") % 3 != 0, "p").when(F.col("id") % 2 == 0, "q").alias("portfolio"), F.col("id").alias("ts"), value.alias("equity")).repartition(7)
    got = risk.drawdown_states(curve).toPandas()
    assert len(got) == n
    for name, g in got.groupby("portfolio", dropna=False):
        g, m = g.sort_values("ts"), risk.Drawdown()
        assert [m.update(x)[0] for x in g["equity"]] == g["state"].tolist(), name
        assert set(g["state"]) == {"NORMAL", "REDUCED", "HALTED", "RECOVERING"}
    assert "FlatMapGroups" not in risk.drawdown_states(curve)._jdf.queryExecution().optimizedPlan().toString()


def test_correlations_of_many_groups(spark):
    rng = np.random.default_rng(5)
    values = {f"u{i}": rng.normal(size=rng.integers(20, 70)).round(3) for i in range(23)}
    values["u3"] = np.ones(40)
    rows = [("k" if i % 2 else "l", u, T0 + dt.timedelta(hours=int(h)), float(v)) for i, (u, x) in enumerate(values.items()) for h, v in enumerate(x)]
    frame = spark.createDataFrame([*rows, ("k", "u1", T0 + dt.timedelta(days=99), None)], "kind string, symbol string, ts timestamp_ntz, ret double")
    for within in ((), ("kind",)):
        got = joins.pair_correlations(frame, tail="pair", within=within, block=16, together=4).collect()
        kind = {u: "k" if i % 2 else "l" for i, u in enumerate(values)}
        units = sorted(u for u, x in values.items() if len(x) >= 24)
        want = {(a, b) for a in units for b in units if a <= b and (not within or kind[a] == kind[b])}
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
        for r in got:
            n = min(len(values[r.a]), len(values[r.b]))
            x, y = values[r.a][-n:], values[r.b][-n:]
            assert r.points == n
            if "u3" in (r.a, r.b):
                assert r.r is None
            else:
                assert r.r == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)


def test_feature_correlations_leave_out_missing_values(spark):
    from tidemark.operators.ml import feature_correlations

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4)) + 1e6
    x[:, 1] = x[:, 0] * -2 + rng.normal(size=400) * 0.01
    x[:, 3] = 7.0
    x[rng.random((400, 4)) < 0.2] = np.nan
    rows = [[None if np.isnan(v) and i % 2 else float(v) for v in r] for i, r in enumerate(x)]
    got = feature_correlations(spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5), list("abcd"), -1.0).collect()
    frame = pd.DataFrame(x, columns=list("abcd")).corr()
    assert {(r.a, r.b): r.r for r in got} == {(p, q): pytest.approx(frame.loc[p, q], abs=6e-5) for p, q in (("a", "b"), ("a", "c"), ("b", "c"))}


def test_importance_is_the_rise_in_loss(spark, walk):
    import hashlib

    from tidemark.operators import ml

    rows = walk.where("symbol <> 'CCC' OR hour(ts) = 1").withColumns({"x1": F.sin(F.col("volume")), "x2": F.cos(F.col("open")), "x3": F.lit(1.0)})
    rows = rows.withColumns({"label": (F.when(F.col("x1") > 0.3, 0).when(F.col("x1") < -0.3, 2).otherwise(1)), "forward_pct": F.col("x1") * 2})

    def fixed(d):
        e = [F.exp(2 * F.col("x1")), F.lit(1.0), F.exp(-2 * F.col("x1") + 0.1 * F.col("x2"))]
        total = e[0] + e[1] + e[2]
        return d.withColumns({"prob_up": e[0] / total, "prob_flat": e[1] / total, "prob_down": e[2] / total, "magnitude": 1.5 * F.col("x1")})

    repeats = 3
    got = {r.feature_name: r.importance for r in ml.permutation_importance(fixed, rows, ["x1", "x2", "x3"], repeats).collect()}
    frame = rows.select("symbol", F.col("ts").cast("string").alias("at"), "ts", "x1", "x2", "x3", "label", "forward_pct").toPandas()

    def loss(x):
        e = np.column_stack([np.exp(2 * x["x1"]), np.ones(len(x)), np.exp(-2 * x["x1"] + 0.1 * x["x2"])])
        p = (e / e.sum(axis=1, keepdims=True))[np.arange(len(x)), x["label"]]
        off = (1.5 * x["x1"] - x["forward_pct"]).abs()
        return float((-np.log(p) + np.where(off <= 1, off**2 / 2, off - 0.5)).mean())

    frame["mark"] = [hashlib.md5(t.encode()).hexdigest() for t in frame["at"]]
    frame = frame.sort_values(["symbol", "mark"], ignore_index=True)
    for f in ("x1", "x2", "x3"):
        total = 0.0
        for k in range(1, repeats + 1):
            moved = frame.copy()
            moved[f] = frame.groupby("symbol")[f].transform(lambda v, k=k: np.roll(v.to_numpy(), -k))
            total += loss(moved)
        assert got[f] == pytest.approx(total / repeats - loss(frame), abs=1e-9), f
    assert got["x1"] > 0.5 and abs(got["x3"]) < 1e-12 and got["x1"] > got["x2"]
    few = rows.where("symbol = 'AAA'").orderBy("ts").limit(2)
    assert ml.permutation_importance(fixed, few, ["x1", "x2"], 5).count() == 2


def test_temperature_search_against_a_fine_grid(spark):
    rng = np.random.default_rng(3)
    for sharp in (0.3, 1.0, 4.0):
        logits = rng.normal(size=(4000, 3)) * 1.5
        true = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        y = [rng.choice(3, p=p) for p in true]
        said = np.exp(logits * sharp)
        said /= said.sum(axis=1, keepdims=True)
        frame = spark.createDataFrame([(*map(float, p), ("UP", "FLAT", "DOWN")[k]) for p, k in zip(said, y, strict=True)], "prob_up double, prob_flat double, prob_down double, actual_direction string").cache()
        t, nll = monitor.fitted_temperature(frame)
        grid = np.arange(0.05, 8, 0.0005)
        logs = np.log(np.maximum(said, 1e-12))
        at = [np.mean(np.log(np.exp(logs / g).sum(axis=1)) - logs[np.arange(4000), y] / g) for g in grid[::20]]
        near = grid[::20][int(np.argmin(at))]
        fine = grid[(grid > near - 0.02) & (grid < near + 0.02)]
        best = fine[int(np.argmin([np.mean(np.log(np.exp(logs / g).sum(axis=1)) - logs[np.arange(4000), y] / g) for g in fine]))]
        assert abs(t - best) < 1e-3 + 2e-3 * (t == 1.0) and nll <= min(at) + 1e-9
        frame.unpersist()
    sure = spark.createDataFrame([(1.0, 0.0, 0.0, "UP")] * 5, "prob_up double, prob_flat double, prob_down double, actual_direction string")
    assert monitor.fitted_temperature(sure)[0] >= monitor.COLDEST
    assert monitor.fitted_temperature(sure.where("false"))[0] == 1.0


def test_sketched_coverage_adds_up(spark):
    from tidemark.operators import quality

    rows = spark.range(60_000).select(F.concat(F.lit("s"), F.col("id") % 20_000).alias("symbol"), F.when(F.col("id") % 3 == 0, "60").otherwise("15").alias("interval"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"))
    sketches = quality.coverage_sketches(rows.withColumn("day", F.to_date("ts")), ["day"])
    got = {r.interval: r for r in quality.sketched_coverage(sketches).collect()}
    for r in quality.coverage(rows).collect():
        s = got[r.interval]
        assert abs(s.symbols / r.symbols - 1) < 0.05 and (s.candles, s.first_ts, s.last_ts) == (r.candles, r.first_ts, r.last_ts)


def test_few_rows_keep_the_threshold(spark):
    for n in (19, 20):
        rows = spark.range(n).select((F.col("id") / 1000).alias("magnitude"), (F.col("id") / 900 - 0.01).alias("actual_magnitude"))
        got = scoring.sharpe_threshold(scoring.sharpe_grid(rows, 0.002, 0.015), 0.0049, 0.002, 0.015).first()
        assert (got.threshold == 0.0049) == (n < 20), n


def test_models_are_chosen_with_enough_records(spark):
    rows = [("a", "r", "m1", 5, 0.9), ("a", "r", "m2", 500, 0.2), ("b", "r", "m1", 5, 0.9), ("b", "r", "m2", 5, 0.1), ("c", "r", "m1", 400, 0.5), ("c", "r", "m2", 400, 0.4)]
    perf = spark.createDataFrame(rows, "symbol string, regime string, model string, n long, score double")
    got = {r.symbol: r.model for r in ensemble.selected_models(perf, 100).collect()}
    assert got == {"a": "m2", "b": "m1", "c": "m1"}


def known_regimes(spark, n=400):
    """Features of four kinds of hours far apart from each other."""
    rng, rows = np.random.default_rng(9), []
    for i in range(4 * n):
        kind = i % 4
        ret, vol = ((0.02, 0.01), (-0.02, 0.01), (0.0, 0.004), (0.0, 0.08))[kind]
        rows.append((kind, *(float(x) for x in (ret + rng.normal(0, 0.001), 3 * ret + rng.normal(0, 0.002), vol + rng.normal(0, 0.0005), 4 * abs(ret) + rng.normal(0, 0.002), rng.normal(0, 0.05)))))
    return spark.createDataFrame(rows, "kind int, ret1 double, ret4 double, vol24 double, trend double, volume_change double")


def test_mixture_finds_known_regimes(spark):
    got = regime.fitted(known_regimes(spark)).groupBy("kind", "regime").count().collect()
    most = {}
    for r in got:
        most[r.kind] = max(most.get(r.kind, (0, "")), (r["count"], r.regime))
    assert {k: name for k, (_, name) in most.items()} == {0: "UP", 1: "DOWN", 2: "RANGING", 3: "HIGH_VOL"}
    assert all(c >= 380 for c, _ in most.values())


def test_boosting_learns_known_classes(spark):
    from tidemark.operators import ml

    d = spark.range(1500).select(F.lit("A").alias("symbol"), F.lit("60").alias("interval"), F.col("id").alias("ts"), F.sin(F.col("id")).alias("x"), F.cos(F.col("id") * 7).alias("noise"))
    d = d.withColumns({"label": F.when(F.col("x") > 0.4, 0).when(F.col("x") < -0.4, 2).otherwise(1), "forward_pct": F.col("x") * 0.1}).cache()
    got = ml.score(ml.fit_boosting(d, ["x", "noise"]), d, ["x", "noise"]).toPandas()
    assert np.allclose(got[["prob_up", "prob_flat", "prob_down"]].sum(axis=1), 1)
    names = np.array(["UP", "FLAT", "DOWN"])[got["label"]]
    assert (got["direction"] == names).mean() > 0.97 and np.abs(got["magnitude"] - got["forward_pct"]).mean() < 0.01
    few = ml.fit_boosting(d, ["x", "noise"], iterations=3)
    importance = {r.feature_name: r.importance for r in ml.permutation_importance(few, d, ["x", "noise"], 2).collect()}
    assert importance["x"] > 0.1 > abs(importance["noise"])


def test_clusters_of_known_symbols(spark):
    from tidemark.operators import ml

    rng = np.random.default_rng(2)
    rows = [(f"{kind}{i}", 100, float(m + rng.normal(0, 1e-5)), float(s), float(k), 3.0, float(a)) for kind, m, s, k, a in (("calm", 0.0, 0.01, 0.0, 0.0), ("wild", 0.0, 0.2, 2.0, -0.3), ("trend", 0.01, 0.05, 0.5, 0.4)) for i in range(12)]
    got = ml.clusters(spark.createDataFrame(rows, "symbol string, n long, mean double, std double, skew double, kurtosis double, autocorrelation double"), 3).collect()
    by = {}
    for r in got:
        by.setdefault(r.symbol.rstrip("0123456789"), set()).add(r.cluster)
    assert all(len(c) == 1 for c in by.values()) and len(set.union(*by.values())) == 3


def test_bars_without_symbol_or_time_stay(spark):
    rows = [("A", T0, 1.0), ("A", None, 2.0), (None, T0, 3.0), ("B", T0 + dt.timedelta(days=3), 4.0)]
    b = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")
    side = spark.createDataFrame([("A", T0, 5.0), (None, T0, 6.0), ("B", T0, 7.0), ("A", None, 8.0)], "symbol string, ts timestamp_ntz, v double")
    got = joins.as_of_all(b, [joins.Side(side, ["v"])]).collect()
    assert sorted((r.close, r.v) for r in got if r.v is not None) == [(1.0, 5.0), (3.0, 6.0), (4.0, 7.0)] and len(got) == 4
