"""Queries over candles, quality, alignment and scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import dataset, indicators, joins, quality, scoring
from tidemark.plans.registry import query
from tidemark.plans.sql import S, div, pct, r, roll, sql
from tidemark.session import shared_folder, stored
from tidemark.sources import bars, payloads, store

H = bars.candles


def at(day: str):
    return F.lit(f"{day} 00:00:00").cast("timestamp_ntz")


@query(
    sql(f"""SELECT symbol, "interval", ts, {r('close', 'close')}, {r('williams_r', 'williams_r')}, {r('bb_pct', 'bb_pct')}, {r('roc_12', 'roc_12')},
        {r('pct_change_4', 'pct_change_4')}, prev_direction
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol, "interval" ORDER BY ts DESC) AS rn, lag(fd) OVER ({S}) AS prev_direction FROM (
      SELECT *, -100 * {div(roll('max', 'high', 14) + ' - close', roll('max', 'high', 14) + ' - ' + roll('min', 'low', 14))} AS williams_r,
        {div(f"close - ({roll('avg', 'close', 20)} - 2 * {roll('stddev_pop', 'close', 20)})", f"4 * {roll('stddev_pop', 'close', 20)}")} AS bb_pct,
        100 * {pct('close', 12)} AS roc_12, {pct('close', 4)} AS pct_change_4,
        CASE WHEN (lead(close) OVER ({S}) - close) / close > 0.5 THEN 'UP' WHEN (lead(close) OVER ({S}) - close) / close < -0.5 THEN 'DOWN' WHEN lead(close)
        OVER ({S}) IS NOT NULL THEN 'FLAT' END AS fd
      FROM candles_60 WHERE close > 0 AND high >= low AND volume >= 0)) WHERE rn = 1""")
)
def flagship_signals(spark, d):
    """Latest signals per symbol: validated candles, windows, and how the last labelled bar went."""
    x = dataset.labelled(indicators.bands(indicators.momentum(quality.valid(H(spark, d)))), threshold=0.5)
    x = x.withColumns({"rn": F.row_number().over(quality.series_desc()), "prev_direction": F.lag("forward_direction").over(C.series())})
    return x.where("rn = 1").select("symbol", "interval", "ts", "close", "williams_r", "bb_pct", "roc_12", "pct_change_4", "prev_direction")


@query(sql("""SELECT symbol, "interval", ts, arrival, CASE WHEN close <= 0 THEN 'close' WHEN high < low THEN 'range' WHEN volume < 0 THEN 'volume'
    END AS reject_reason FROM candles_raw"""))
def candle_validation(spark, d):
    return quality.validated(bars.damaged(H(spark, d))).select("symbol", "interval", "ts", "arrival", "reject_reason")


@query(
    sql(f"""SELECT symbol, "interval", ts, coalesce(abs({pct('close')}) > 0.5, false) AS is_jump FROM (SELECT * FROM candles_raw WHERE NOT (close <= 0
        OR high < low OR volume < 0) AND arrival = 0)""")
)
def candle_jumps(spark, d):
    return quality.jumps(bars.damaged(H(spark, d)).where("arrival = 0")).select("symbol", "interval", "ts", "is_jump")


@query(sql(f"""SELECT * FROM (SELECT symbol, "interval", lag(ts) OVER ({S}) AS gap_start, ts AS gap_end, CAST(date_diff('second', lag(ts) OVER ({S}), ts)
    // 60 AS BIGINT) AS minutes FROM candles_60) WHERE minutes > 90"""))
def candle_gaps(spark, d):
    return quality.gaps(H(spark, d))


@query(
    sql(f"""SELECT symbol, "interval", ts, max(g) OVER (PARTITION BY symbol, "interval" ORDER BY ts ROWS BETWEEN 22 PRECEDING AND CURRENT ROW) = 1 AS has_gap
    FROM (SELECT *, coalesce(CAST(date_diff('second', lag(ts) OVER ({S}), ts) / 60.0 > 90 AS INTEGER), 0) AS g FROM candles_60)""")
)
def gaps_in_windows(spark, d):
    return quality.gap_in_window(H(spark, d), 24).select("symbol", "interval", "ts", "has_gap")


@query(
    sql("""SELECT 'candles_60' AS table_name, count(*) AS rows, count(DISTINCT symbol) AS symbols, min(ts) AS first_ts, max(ts) AS last_ts FROM candles_60
    UNION ALL SELECT 'candles_15', count(*), count(DISTINCT symbol), min(ts), max(ts) FROM candles_15 UNION ALL SELECT 'order_book', count(*),
    count(DISTINCT symbol), min(ts), max(ts) FROM order_book""")
)
def table_inventory(spark, d):
    t = {"candles_60": H(spark, d), "candles_15": H(spark, d, 15), "order_book": bars.order_book(spark, d)}
    return quality.inventory(t, ["symbol"])


@query(
    sql("""SELECT count(*) FILTER (WHERE close <= 0) AS bad_close, count(*) FILTER (WHERE high < low) AS bad_range, count(*) FILTER (WHERE volume < 0)
        AS bad_volume,
    (SELECT count(*) FROM (SELECT 1 FROM candles_raw GROUP BY symbol, "interval", ts HAVING count(*) > 1)) AS duplicate_keys FROM candles_raw""")
)
def bad_candle_audit(spark, d):
    return quality.audit(bars.damaged(H(spark, d)))


_COVERAGE = sql("""SELECT "interval", count(DISTINCT symbol) AS symbols, count(*) AS candles, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *
    FROM candles_60 UNION ALL SELECT * FROM candles_15 UNION ALL SELECT * FROM candles_user) GROUP BY 1""")


@query(_COVERAGE)
def interval_coverage(spark, d):
    return quality.coverage(H(spark, d).unionByName(H(spark, d, 15)).unionByName(bars.user_candles(spark, d)))


@query(_COVERAGE)
def stored_coverage(spark, d):
    """The same from stored counts of each day's candles by symbol, so that only days that change are read again."""
    tables = [H(spark, d), H(spark, d, 15), bars.user_candles(spark, d)]
    parts = [stored(quality.coverage_parts(t.withColumn("day", F.to_date("ts")), ["day"])) for t in tables]
    return quality.summed_coverage(reduce(DataFrame.unionByName, parts))


@query(
    sql(f"""SELECT source, last_ts, {r('age', 'age_hours')}, age > lim AS is_stale FROM (SELECT source, last_ts, lim, date_diff('second', last_ts,
        TIMESTAMP '2024-01-31') / 3600.0 AS age FROM (
    SELECT 'candles' AS source, max(ts) AS last_ts, 2.0 AS lim FROM candles_60 UNION ALL SELECT 'predictions', max(ts), 2.0 FROM predictions UNION ALL
    SELECT 'order_book', max(ts), 0.3 FROM order_book UNION ALL SELECT 'fear_greed', max(ts), 26.0 FROM fear_greed))""")
)
def source_freshness(spark, d):
    t = {"candles": (H(spark, d), 2.0), "predictions": (bars.predictions(spark, d), 2.0), "order_book": (bars.order_book(spark, d), 0.3), "fear_greed": (bars.fear_greed(spark, d), 26.0)}
    return quality.freshness(t, at("2024-01-31"))


@query(sql("SELECT CAST(ts AS DATE) AS day, count(*) AS snapshots, count(DISTINCT symbol) AS symbols FROM order_book GROUP BY 1 ORDER BY 1 DESC LIMIT 7"))
def snapshots_per_day(spark, d):
    return quality.per_day(bars.order_book(spark, d))


@query(
    sql(f"""SELECT symbol, "interval", candles, {r('zero_share', 'zero_share')}, kept, CASE WHEN kept THEN jumps END AS jumps,
        {r('CASE WHEN kept THEN largest_jump END', 'largest_jump')}, CASE WHEN kept THEN gaps END AS gaps,
        {r('CASE WHEN kept THEN gap_minutes END', 'gap_minutes')}
    FROM (SELECT *, candles >= 100 AND zero_share <= 0.1 AS kept FROM (SELECT symbol, "interval", count(*) AS candles, avg(CAST(volume = 0 AS DOUBLE))
    AS zero_share, count(*) FILTER (WHERE j > 0.5) AS jumps, max(j) FILTER (WHERE j > 0.5) AS largest_jump,
      count(*) FILTER (WHERE step > 1.5 * m) AS gaps, coalesce(sum(step) FILTER (WHERE step > 1.5 * m), 0) AS gap_minutes
      FROM (SELECT *, abs({pct('close')}) AS j, date_diff('second', lag(ts) OVER ({S}), ts) / 60.0 AS step, CAST("interval" AS DOUBLE) AS m FROM (SELECT *
      FROM candles_60 UNION ALL SELECT * FROM candles_user)) GROUP BY 1, 2))""")
)
def training_data_gate(spark, d):
    return quality.training_gate(H(spark, d).unionByName(bars.user_candles(spark, d)))


@query(
    sql(f"""SELECT symbol, "interval", ts, {r('volume_24', 'volume_24')}, CASE WHEN volume_24 < 1000 THEN 'volume' WHEN spread > 50 THEN 'spread' END AS reason,
        (volume_24 >= 1000 AND NOT spread > 50) AS may_enter
    FROM (SELECT *, 1e4 * (high - low) / close / 100 AS spread, sum(volume) OVER (PARTITION BY symbol, "interval" ORDER BY ts ROWS BETWEEN 23 PRECEDING
    AND CURRENT ROW) AS volume_24, row_number() OVER (PARTITION BY symbol, "interval" ORDER BY ts DESC) AS rn FROM candles_60) WHERE rn = 1""")
)
def entry_filter(spark, d):
    spread = C.float_ratio(1e4 * (F.col("high") - F.col("low")), F.col("close")) / 100
    return quality.entry_filter(H(spark, d), spread, least_volume=1000).select("symbol", "interval", "ts", "volume_24", "reason", "may_enter")


@query(sql(f"""SELECT symbol, "interval", ts, {r('close', 'close')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, "interval" ORDER BY ts DESC) AS rn
    FROM candles_60 WHERE ts < TIMESTAMP '2024-01-20') WHERE rn <= 50"""))
def latest_candles(spark, d):
    return joins.latest(H(spark, d), 50, at("2024-01-20")).select("symbol", "interval", "ts", "close")


@query(sql(f"""SELECT symbol, ts, {r('funding_rate', 'funding_rate', 9)} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM funding
    WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15') WHERE rn <= 20"""), digits=9)
def range_read(spark, d):
    return store.between(bars.funding(spark, d), at("2024-01-05"), at("2024-01-15"), 20).select("symbol", "ts", "funding_rate")


@query(
    sql(f"""SELECT symbol, "interval", ts, {r('close', 'close')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, "interval", ts ORDER BY arrival) AS rn
        FROM candles_raw) c
    WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM candles_60 t WHERE t.symbol = c.symbol AND t.ts = c.ts AND t.ts < TIMESTAMP '2024-01-15')""")
)
def insert_ignore(spark, d):
    """First write wins, against what is stored and within the batch."""
    target = H(spark, d).where(F.col("ts") < at("2024-01-15"))
    return store.new_rows(bars.damaged(H(spark, d)), target, ["symbol", "interval", "ts"], "arrival").select("symbol", "interval", "ts", "close")


@query(sql(f"""SELECT symbol, "interval", ts, arrival, {r('close', 'close')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, "interval", ts
    ORDER BY arrival DESC) AS rn FROM candles_raw) WHERE rn = 1"""))
def upsert(spark, d):
    """Last write wins."""
    raw = bars.damaged(H(spark, d))
    return store.upserted(raw.where("arrival = 0"), raw.where("arrival = 1"), ["symbol", "interval", "ts"], "arrival").select("symbol", "interval", "ts", "arrival", "close")


@query(sql("""SELECT symbol, count(b) AS existing, 800 - count(b) AS remaining FROM (SELECT s.symbol, c.ts AS b FROM (SELECT DISTINCT symbol FROM candles_60
    UNION SELECT 'missing') s LEFT JOIN candles_60 c ON s.symbol = c.symbol) GROUP BY 1 HAVING count(b) < 800"""))
def backfill_plan(spark, d):
    c = H(spark, d)
    return store.backfill_plan(c.select("symbol").union(spark.createDataFrame([("missing",)], "symbol string")), c, "60", 800)


@query(sql("""SELECT symbol, "interval", ts, CAST(NULL AS VARCHAR) AS actual_direction FROM candles_60"""))
def schema_backfill(spark, d):
    return store.back_filled(H(spark, d).drop("interval"), {"actual_direction": "string"}).select("symbol", "interval", "ts", "actual_direction")


@query(sql(f"""SELECT symbol, "interval", ts, {r('open', 'open')}, {r('close', 'close')}, {r('volume', 'volume')} FROM candles_60"""))
def kline_payloads(spark, d):
    """Candles out to a JSON payload per symbol and day, and parsed back."""
    c = H(spark, d)
    text = lambda x: F.col(x).cast("string").alias({"volume": "baseVol"}.get(x, x))
    item = F.struct(F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("time"), *[text(x) for x in ("open", "high", "low", "close", "volume")])
    raw = c.groupBy("symbol", "interval", F.to_date("ts").alias("day")).agg(F.to_json(F.struct(F.collect_list(item).alias("data"))).alias("payload"))
    return payloads.klines(raw).select("symbol", "interval", "ts", "open", "close", "volume")


@query(sql(f"""SELECT symbol, ts, CAST(len(bid_vols) AS INTEGER) AS bids, CAST(len(ask_vols) AS INTEGER) AS asks,
    {r('list_sum(bid_vols) / (list_sum(bid_vols) + list_sum(ask_vols))', 'imbalance')}, {r('ask_vols[1] - bid_vols[1]', 'spread')},
    {r('(ask_vols[1] + bid_vols[1]) / 2', 'mid_price')} FROM order_book"""))
def depth_payloads(spark, d):
    """Books out to JSON price and volume pairs, and parsed back; prices are the volumes here."""
    pair = lambda s: F.transform(f"{s}_vols", lambda v: F.array(v.cast("string"), v.cast("string")))
    b = bars.order_book(spark, d).select("symbol", F.to_json(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("ts"), pair("bid").alias("bids"), pair("ask").alias("asks"))).alias("payload"))
    return payloads.depth(b).select("symbol", "ts", F.size("bid_prices").alias("bids"), F.size("ask_prices").alias("asks"), "imbalance", "spread", "mid_price")


@query(sql(f"""SELECT symbol || 'USDT' AS symbol, ts, {r('oi_close', 'oi_close')} FROM derivatives"""))
def history_payloads(spark, d):
    """Open-interest history as nested JSON, exploded twice and mapped to our symbols."""
    h = bars.derivatives(spark, d)
    item = F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.col("oi_close").alias("c"))
    raw = h.groupBy("symbol").agg(F.collect_list(item).alias("history")).select(F.to_json(F.array(F.struct(F.concat("symbol", F.lit(".A")).alias("symbol"), "history"))).alias("payload"))
    names = h.select(F.concat("symbol", F.lit(".A")).alias("market"), F.concat("symbol", F.lit("USDT")).alias("symbol")).distinct()
    return payloads.history(raw, names, {"c": "oi_close"})


@query(sql("""SELECT symbol || 'USDT' AS symbol, ts, positive, negative, neutral, positive + negative + neutral AS total FROM news"""))
def news_payloads(spark, d):
    n = bars.news(spark, d)
    post = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"), F.array(F.struct(F.lower("symbol").alias("code"))).alias("currencies"), F.struct("positive", "negative", F.col("neutral").alias("important")).alias("votes"))
    return payloads.news(n.select(F.to_json(F.struct(F.array(post).alias("results"))).alias("payload")))


@query(sql(f"""SELECT symbol, ts, {r('funding_rate', 'funding_rate', 9)}, {r('mark_price', 'mark_price', 9)}, CAST(8 AS INTEGER) AS funding_interval_hours
    FROM funding"""), digits=9)
def funding_payloads(spark, d):
    f = bars.funding(spark, d)
    item = F.struct("symbol", F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("ts"), F.col("funding_rate").cast("string").alias("fundingRate"), F.col("mark_price").cast("string").alias("markPrice"))
    raw = f.groupBy("symbol").agg(F.to_json(F.struct(F.collect_list(item).alias("data"))).alias("payload"))
    return payloads.funding(raw).select("symbol", "ts", "funding_rate", "mark_price", "funding_interval_hours")


@query(sql("""SELECT DISTINCT symbol FROM candles_60 WHERE lower(symbol) IN (SELECT lower(event_type) FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1
    HAVING count(*) > 10)"""))
def tradeable_symbols(spark, d):
    spot = bars.read(spark, d, "events").where("ts < timestamp_ntz'2024-01-15'").groupBy(F.col("event_type").alias("pair")).agg(F.when(F.count(F.lit(1)) > 10, 1).otherwise(0).alias("is_open"))
    return joins.tradeable(H(spark, d), spot)


@query(sql("""SELECT DISTINCT symbol FROM candles_user WHERE symbol NOT IN (SELECT 'U' || user_id FROM events WHERE event_type = 'purchase'
    AND ts < TIMESTAMP '2024-01-03')"""))
def futures_only_symbols(spark, d):
    spot = bars.read(spark, d, "events").where("event_type = 'purchase' AND ts < timestamp_ntz'2024-01-03'").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("pair"), F.lit(1).alias("is_open"))
    return joins.futures_only(bars.user_candles(spark, d), spot)


@query(
    sql(f"""SELECT c.symbol, c.ts, coalesce(round(d.ratio, 6), 0) + 0.0 AS ratio, coalesce(round(f.value, 6), 0) + 0.0 AS value FROM candles_60 c LEFT
        JOIN (SELECT * FROM derivatives WHERE long_vol > short_vol) d ON c.symbol = d.symbol AND c.ts = d.ts LEFT JOIN fear_greed f ON c.ts = f.ts""")
)
def exact_side_join(spark, d):
    side = bars.derivatives(spark, d).where("long_vol > short_vol")
    x = joins.exact(H(spark, d), side, ["ratio"])
    return joins.exact(x, bars.fear_greed(spark, d), ["value"], ["ts"]).select("symbol", "ts", "ratio", "value")


@query(
    sql(f"""SELECT c.symbol, c."interval", c.ts, round(f.funding_rate, 9) + 0.0 AS funding_rate, coalesce(round(CASE WHEN date_diff('second', f.ts, c.ts)
        <= 14400 THEN f.mark_price END, 9), -1) + 0.0 AS fresh_mark
    FROM candles_15 c ASOF LEFT JOIN funding f ON c.symbol = f.symbol AND c.ts >= f.ts"""),
    digits=9,
)
def as_of_join(spark, d):
    """Latest funding at or before each quarter-hour candle, once without and once with an age limit."""
    f = bars.funding(spark, d)
    x = joins.as_of(H(spark, d, 15), f, ["funding_rate"])
    return joins.as_of(x, f.withColumnRenamed("mark_price", "fresh_mark"), ["fresh_mark"], max_age_minutes=240, fills={"fresh_mark": -1.0}).select("symbol", "interval", "ts", "funding_rate", "fresh_mark")


def scored(spark, d):
    return joins.outcomes(bars.predictions(spark, d), H(spark, d), 0.5)


@query(sql(f"""SELECT symbol, "interval", ts, direction, {r('actual_magnitude', 'actual_magnitude')}, actual_direction,
    actual_direction = direction AS was_correct, scored_at FROM scored"""))
def outcome_join(spark, d):
    return scored(spark, d).where("scored_at IS NOT NULL").select("symbol", "interval", "ts", "direction", "actual_magnitude", "actual_direction", "was_correct", "scored_at")


@query(sql("""SELECT p.symbol, p."interval", p.ts FROM predictions p LEFT JOIN scored s ON p.symbol = s.symbol AND p.ts = s.ts WHERE s.ts IS NULL"""))
def unscored_predictions(spark, d):
    return scoring.unscored(scored(spark, d)).select("symbol", "interval", "ts")


@query(sql("""SELECT symbol, ts, scored_at FROM scored WHERE scored_at >= TIMESTAMP '2024-01-24'"""))
def recently_scored(spark, d):
    return scoring.scored_since(scored(spark, d), at("2024-01-31"), 7).select("symbol", "ts", "scored_at")


@query(
    sql(f"""SELECT symbol, ts, {r("last_value(a IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)", 'a_value', 9)},
        {r("last_value(b IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)", 'b_value', 9)}
    FROM (SELECT coalesce(x.symbol, y.symbol) AS symbol, coalesce(x.ts, y.ts) AS ts, x.funding_rate AS a, y.funding_rate AS b FROM funding x FULL
    JOIN funding_b y ON x.symbol = y.symbol AND x.ts = y.ts)"""),
    digits=9,
)
def cross_exchange_fill(spark, d):
    return joins.filled_outer(bars.funding(spark, d), bars.funding(spark, d, 6), "funding_rate")


@query(
    sql(f"""WITH ret AS (SELECT symbol, ts, {pct('close')} AS ret FROM candles_60), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC)
        AS back, count(*) OVER (PARTITION BY symbol) AS n FROM ret WHERE ret IS NOT NULL),
    t AS (SELECT * FROM k WHERE n >= 24 AND back <= (SELECT min(n) FROM k WHERE n >= 24))
    SELECT x.symbol AS a, y.symbol AS b, count(*) AS points, {r('corr(x.ret, y.ret)', 'r')}, abs(corr(x.ret, y.ret)) >= 0.7 AND count(*) >= 10 AS is_correlated
    FROM t x JOIN t y ON x.back = y.back AND x.symbol <= y.symbol GROUP BY 1, 2""")
)
def symbol_correlations(spark, d):
    return joins.pair_correlations(H(spark, d).withColumn("ret", C.pct("close")))


@query(
    sql("""WITH m AS (SELECT event_type AS base, 'usdt' AS quote, 'm' || (user_id % 3) AS market, max(user_id % 3) AS pos FROM events GROUP BY ALL)
    SELECT symbol, max_by(market, pos) AS market FROM (SELECT DISTINCT upper(event_type) || '-USDT' AS symbol, upper(event_type) || 'USDT' AS k FROM events) s
    JOIN m ON upper(m.base || m.quote) = s.k GROUP BY 1""")
)
def symbol_mapping(spark, d):
    e = bars.read(spark, d, "events")
    m = e.groupBy(F.col("event_type").alias("base"), F.lit("usdt").alias("quote"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("market")).agg(F.max(F.col("user_id") % 3).alias("pos")).withColumn("is_perpetual", F.lit(True))
    ours = e.select(F.concat(F.upper("event_type"), F.lit("-USDT")).alias("symbol")).distinct()
    return joins.symbol_map(m, ours)


def _prf(c: str) -> str:
    both = f"count(*) FILTER (WHERE actual_direction = '{c}' AND direction = '{c}')"
    p, q = (f"coalesce({div(both, f'count(*) FILTER (WHERE {col} = {chr(39)}{c}{chr(39)})')}, 0)" for col in ("direction", "actual_direction"))
    return f"{r(p, c.lower() + '_precision')}, {r(q, c.lower() + '_recall')}"


@query(sql(f"""SELECT count(*) AS total_preds, {r('avg(CAST(actual_direction = direction AS DOUBLE))', 'direction_accuracy')},
    {r('avg(abs(magnitude - actual_magnitude))', 'magnitude_mae')}, {_prf('UP')}, {_prf('DOWN')}, {_prf('FLAT')}, CAST(0.5 AS DOUBLE) AS flat_threshold_used
    FROM scored"""))
def accuracy_report(spark, d):
    return scoring.accuracy_report(scored(spark, d).where("scored_at IS NOT NULL"), 0.5)


@query(
    sql(f"""WITH s AS (SELECT symbol, count(*) AS n_preds, avg(CAST(actual_direction = direction AS DOUBLE)) AS hit FROM scored GROUP BY 1 HAVING count(*)
        >= 3), k AS (SELECT *, row_number() OVER (ORDER BY hit DESC, symbol) AS b, row_number() OVER (ORDER BY hit, symbol) AS w FROM s)
    SELECT symbol, n_preds, {r('hit', 'hit_rate')}, CAST(b AS INTEGER) AS best_rank, CAST(w AS INTEGER) AS worst_rank FROM k WHERE b <= 2 OR w <= 2""")
)
def best_and_worst_symbols(spark, d):
    return scoring.best_and_worst(scored(spark, d).where("scored_at IS NOT NULL"), 2)


@query(sql(f"""SELECT "interval", CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE actual_direction = direction) AS correct,
    {r("100.0 * count(*) FILTER (WHERE actual_direction = direction) / count(*)", 'pct', 1)} FROM scored GROUP BY 1, 2"""))
def daily_accuracy(spark, d):
    return scoring.daily_accuracy(scored(spark, d).where("scored_at IS NOT NULL"))


@query(
    sql(f"""SELECT "interval", count(*) AS n, {r('avg(CASE WHEN actual_direction = direction THEN 1.0 ELSE 0.0 END)', 'accuracy')}
    FROM scored WHERE scored_at >= TIMESTAMP '2024-01-24' GROUP BY 1""")
)
def recent_interval_accuracy(spark, d):
    """Accuracy of each interval's predictions that were scored in the last week."""
    return scoring.interval_accuracy(scored(spark, d), at("2024-01-31"), 7)


@query(
    sql(f"""SELECT CAST(scored_at AS DATE) AS run_date, count(*) AS total_preds, {r('avg(CAST(actual_direction = direction AS DOUBLE))', 'direction_accuracy')},
    {r('avg(abs(magnitude - actual_magnitude))', 'magnitude_mae')}, {_prf('UP')}, {_prf('DOWN')}, {_prf('FLAT')}, CAST(0.5 AS DOUBLE) AS flat_threshold_used
    FROM scored GROUP BY 1 HAVING CAST(scored_at AS DATE) >= DATE '2024-01-21'""")
)
def accuracy_history(spark, d):
    """The daily accuracy log of the last ten days."""
    s = scored(spark, d).where("scored_at IS NOT NULL").withColumn("run_date", F.to_date("scored_at"))
    return scoring.accuracy_history(scoring.accuracy_report(s, 0.5, ["run_date"]), at("2024-01-31"), 10)


@query(sql(f"""SELECT symbol, n AS n_preds, {r('e', 'error_rate')}, {r('least(5, 1 + e / avg(e) OVER ())', 'weight')} FROM (SELECT symbol, count(*) AS n,
    1 - avg(CAST(actual_direction = direction AS DOUBLE)) AS e FROM scored GROUP BY 1 HAVING count(*) >= 5)"""))
def symbol_sample_weights(spark, d):
    return scoring.sample_weights(scored(spark, d).where("scored_at IS NOT NULL"))


@query(
    sql(f"""SELECT symbol, n AS n_preds, {r('CASE WHEN n < 5 THEN 1 ELSE least(5, greatest(0.5, 1 + CASE WHEN gain > 0 THEN loss / gain ELSE 2 END)) END', 'weight')}
    FROM (SELECT symbol, count(*) AS n, coalesce(avg(abs(actual_magnitude)) FILTER (WHERE actual_direction <> direction), 0) AS loss,
    coalesce(avg(abs(actual_magnitude)) FILTER (WHERE actual_direction = direction), 0) AS gain FROM scored GROUP BY 1)""")
)
def pnl_sample_weights(spark, d):
    return scoring.pnl_weights(scored(spark, d).where("scored_at IS NOT NULL"))


_GRID = "SELECT 0.1 + (0.8 - 0.1) * i / 49 AS threshold FROM range(50) t(i)"
_DIR = lambda x: f"CASE WHEN {x} > threshold THEN 1 WHEN {x} < -threshold THEN -1 ELSE 0 END"
_SPLIT = "CASE WHEN k % 10 < 7 THEN 'tune' ELSE 'eval' END"


@query(
    sql(f"""WITH s AS (SELECT *, 10 * magnitude AS m, {_SPLIT} AS split FROM scored), g AS ({_GRID})
    SELECT {r('threshold', 'threshold', 9)}, split, count(*) AS rows, {r(f"avg(CAST(({_DIR('m')}) = ({_DIR('actual_magnitude')}) AS DOUBLE))", 'accuracy', 9)}
    FROM s CROSS JOIN g GROUP BY threshold, split"""),
    digits=9,
)
def threshold_grid_accuracy(spark, d):
    s = scored(spark, d).where("scored_at IS NOT NULL").withColumn("magnitude", 10 * F.col("magnitude"))
    return scoring.threshold_grid(s, F.when(F.col("k") % 10 < 7, "tune").otherwise("eval"), 0.1, 0.8)


@query(
    sql(f"""WITH s AS (SELECT *, 10 * magnitude AS m, {_SPLIT} AS split FROM scored), g AS ({_GRID}), q AS (SELECT threshold, split, avg(CAST(({_DIR('m')})
        = ({_DIR('actual_magnitude')}) AS DOUBLE)) AS acc FROM s CROSS JOIN g GROUP BY 1, 2),
    b AS (SELECT threshold AS best, acc AS tune_accuracy FROM q WHERE split = 'tune' ORDER BY acc DESC, threshold LIMIT 1), v AS (SELECT b.*,
    q.acc AS eval_accuracy FROM b JOIN q ON q.threshold = b.best AND q.split = 'eval'),
    c AS (SELECT count(*) AS rows, avg(CAST(({_DIR('m')}) = ({_DIR('actual_magnitude')}) AS DOUBLE)) FILTER (WHERE split = 'eval') AS cur FROM s CROSS
    JOIN (SELECT CAST(0.5 AS DOUBLE) AS threshold))
    SELECT rows, {r('best', 'best')}, {r('tune_accuracy', 'tune_accuracy')}, {r('eval_accuracy', 'eval_accuracy')}, {r('cur', 'current_accuracy')},
    {r('CASE WHEN rows >= 20 AND eval_accuracy > cur THEN greatest(0.1, least(0.8, 0.3 * best + 0.7 * 0.5)) ELSE 0.5 END', 'threshold')} FROM v CROSS JOIN c""")
)
def optimal_threshold(spark, d):
    s = scored(spark, d).where("scored_at IS NOT NULL").withColumn("magnitude", 10 * F.col("magnitude"))
    return scoring.optimal_threshold(s, F.when(F.col("k") % 10 < 7, "tune").otherwise("eval"), 0.5, 0.1, 0.8)


@query(
    sql(f"""WITH g AS ({_GRID}), x AS (SELECT threshold, actual_magnitude * ({_DIR('actual_magnitude')}) AS pnl FROM scored CROSS JOIN g)
    SELECT {r('threshold', 'threshold')}, count(*) AS rows, {r('avg(pnl)', 'mean_pnl')},
    {r('CASE WHEN count(*) < 2 OR stddev_samp(pnl) < 1e-10 THEN 0 ELSE avg(pnl) / stddev_samp(pnl) * sqrt(8760) END', 'sharpe')} FROM x GROUP BY threshold""")
)
def threshold_grid_sharpe(spark, d):
    return scoring.sharpe_grid(scored(spark, d).where("scored_at IS NOT NULL"), 0.1, 0.8)


@query(
    sql(f"""WITH g AS ({_GRID}), x AS (SELECT threshold, actual_magnitude * ({_DIR('actual_magnitude')}) AS pnl FROM scored CROSS JOIN g),
    s AS (SELECT threshold, CASE WHEN count(*) < 2 OR stddev_samp(pnl) < 1e-10 THEN 0 ELSE avg(pnl) / stddev_samp(pnl) * sqrt(8760) END AS sharpe FROM x
    GROUP BY 1),
    b AS (SELECT * FROM s ORDER BY round(sharpe, 9) DESC, threshold LIMIT 1)
    SELECT {r('threshold', 'best')}, {r('sharpe', 'sharpe')}, {r('greatest(0.1, least(0.8, 0.3 * threshold + 0.7 * 0.5))', 'threshold')} FROM b""")
)
def sharpe_threshold(spark, d):
    """The threshold with the best Sharpe ratio, smoothed with the current one."""
    grid = scoring.sharpe_grid(scored(spark, d).where("scored_at IS NOT NULL"), 0.1, 0.8)
    return scoring.sharpe_threshold(grid, 0.5, 0.1, 0.8)


@query(
    sql(f"""SELECT model, {r('arg_max(sharpe, day)', 'sharpe')} FROM (SELECT model, CAST(ts AS DATE) AS day, avg(magnitude) * 100 AS sharpe
        FROM model_predictions GROUP BY ALL) GROUP BY 1""")
)
def model_sharpes(spark, d):
    """The last stored Sharpe ratio of each model."""
    p = bars.model_predictions(spark, d).groupBy("model", "interval", F.to_date("ts").alias("updated_at")).agg((100 * F.avg("magnitude")).alias("sharpe"))
    return scoring.model_sharpes(p, "60")


@query(sql(f"""SELECT direction AS label, count(*) AS n, {r('least(3, 3 * (1 / count(*)) / sum(1 / count(*)) OVER ())', 'weight')} FROM predictions GROUP BY 1"""))
def class_weights(spark, d):
    return scoring.class_weights(bars.predictions(spark, d), "direction")


_IMP = """imp AS (SELECT time_bucket(INTERVAL '1 day', e_ts) AS run_date, symbol AS feature_name, '60' AS "interval", avg(k) / 100 - 0.49 AS importance FROM e
    GROUP BY ALL)"""


def importance(spark, d):
    e = bars.events(spark, d).groupBy(bars.bucket("ts", 1440).alias("run_date"), F.col("event_type").alias("feature_name")).agg((F.avg("k") / 100 - 0.49).alias("importance"))
    return e.withColumn("interval", F.lit("60"))


@query(
    sql(f"""WITH {_IMP} SELECT "interval", feature_name, {r('avg(importance)', 'mean_importance')}, count(*) AS n FROM (SELECT *, dense_rank()
        OVER (PARTITION BY "interval" ORDER BY run_date DESC) AS rk FROM imp) WHERE rk <= 3 GROUP BY 1, 2 HAVING avg(importance) < 0.01 AND count(*) >= 3""")
)
def low_importance_features(spark, d):
    return scoring.low_importance(importance(spark, d), 3, 0.01)


@query(
    sql(f"""WITH {_IMP} SELECT "interval", feature_name, count(*) FILTER (WHERE g IS NULL OR run_date > g) AS below_count, count(*) FILTER (WHERE g IS NULL
        OR run_date > g) >= 3 AS is_retired
    FROM (SELECT *, max(CASE WHEN importance >= 0.04 THEN run_date END) OVER (PARTITION BY "interval", feature_name) AS g FROM imp) GROUP BY 1, 2""")
)
def feature_retirement(spark, d):
    return scoring.retirement(importance(spark, d), 0.04)


@query(
    sql(f"""WITH {_IMP} SELECT feature_name FROM (SELECT *, max(CASE WHEN importance >= 0.04 THEN run_date END) OVER (PARTITION BY "interval", feature_name)
        AS g FROM imp)
    GROUP BY 1 HAVING count(*) FILTER (WHERE g IS NULL OR run_date > g) >= 3""")
)
def retired_features(spark, d):
    return scoring.retired_features(scoring.retirement(importance(spark, d), 0.04), "60")


@query(
    sql(f"""WITH l AS (SELECT *, row_number() OVER (ORDER BY scored_at, symbol DESC) AS i FROM (SELECT * FROM scored ORDER BY scored_at DESC,
        symbol LIMIT 200)),
    x AS (SELECT CAST(0 AS BIGINT) AS i, CAST(10000 AS DOUBLE) AS equity UNION ALL SELECT l.i, CASE WHEN direction = 'FLAT' THEN equity
      WHEN direction = actual_direction THEN equity + equity * abs(magnitude) ELSE equity - equity * abs(magnitude) * 0.5 END FROM x JOIN l ON l.i = x.i + 1)
    SELECT max(i) AS n, {r('arg_max(equity, i)', 'equity')} FROM x""", recursive=True)
)
def simulated_equity(spark, d):
    return scoring.simulated_equity(scored(spark, d))


@query(sql(f"""SELECT symbol, {r('sum(value)', 'total')} FROM e GROUP BY 1"""))
def json_list_sums(spark, d):
    """Number lists as JSON text, summed; a bare number counts as itself and bad text as nothing."""
    e = bars.read(spark, d, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.collect_list("value").alias("v"))
    t = e.select("symbol", F.explode(F.array(F.to_json("v"), F.lit("not a list"), F.lit("0"))).alias("text"))
    return t.select("symbol", C.number_list_sum("text").alias("x")).groupBy("symbol").agg(F.sum("x").alias("total"))


@query(sql(f"""SELECT symbol, ts, {r('funding_rate', 'funding_rate', 9)} FROM funding WHERE abs(funding_rate) > 0.0001 ORDER BY ts DESC, symbol LIMIT 20"""), digits=9)
def extreme_funding(spark, d):
    return bars.funding(spark, d).where(F.abs("funding_rate") > 0.0001).orderBy(F.desc("ts"), "symbol").limit(20).select("symbol", "ts", "funding_rate")


@query(sql(f"""SELECT symbol || 'USDT' AS symbol, {r('arg_max(close, ts)', 'last_price')}, {r('max(high)', 'high_24h')}, {r('min(low)', 'low_24h')},
    CAST(0 AS DOUBLE) AS quote_vol FROM candles_60 GROUP BY 1"""))
def ticker_payloads(spark, d):
    t = H(spark, d).groupBy("symbol").agg(F.max_by("close", "ts").alias("c"), F.max("high").alias("h"), F.min("low").alias("l"))
    item = F.struct(F.concat("symbol", F.lit("USDT")).alias("symbol"), F.col("c").cast("string").alias("lastPrice"), F.col("h").cast("string").alias("high"), F.col("l").cast("string").alias("low"), F.lit("bad").alias("quoteVol"))
    return payloads.tickers(t.select(F.to_json(F.struct(F.array(item).alias("data"))).alias("payload"))).select("symbol", "last_price", "high_24h", "low_24h", "quote_vol")


@query(sql(f"""SELECT ts, {r('value', 'value')}, 'Neutral' AS label FROM fear_greed"""))
def fear_greed_payloads(spark, d):
    f = bars.fear_greed(spark, d)
    item = F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"), F.col("value").cast("string").alias("value"))
    return payloads.fear_greed(f.select(F.to_json(F.struct(F.array(item).alias("data"))).alias("payload")))


@query(sql(f"""SELECT symbol || 'USDT' AS symbol, ts, {r('funding_rate', 'funding_rate', 9)} FROM funding WHERE symbol <> 'click'"""), digits=9)
def other_exchange_payloads(spark, d):
    """Only symbols in the quote currency are kept."""
    f = bars.funding(spark, d)
    name = F.concat("symbol", F.when(F.col("symbol") == "click", "BTC").otherwise("USDT"))
    item = F.struct(name.alias("symbol"), F.unix_millis(F.col("ts").cast("timestamp")).alias("fundingTime"), F.col("funding_rate").cast("string").alias("fundingRate"))
    return payloads.other_funding(f.select(F.to_json(F.array(item)).alias("payload")))


@query(sql(f"""SELECT symbol, ts, {r('oi_close', 'oi_value')} FROM derivatives"""))
def other_interest_payloads(spark, d):
    """Another exchange's open interest, a payload a symbol and time."""
    x = F.struct("symbol", F.col("oi_close").cast("string").alias("openInterest"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time"))
    return payloads.other_interest(bars.derivatives(spark, d).select(F.to_json(x).alias("payload")))


@query(sql("""SELECT p.symbol, p.ts, CASE WHEN p.k < 50 THEN s.actual_direction END AS actual_direction FROM predictions p LEFT
    JOIN scored s ON p.symbol = s.symbol AND p.ts = s.ts"""))
def update_outcomes(spark, d):
    """Outcomes of some predictions set by key, the others left as they are."""
    new = scored(spark, d).where("scored_at IS NOT NULL AND k < 50")
    return store.updated_outcomes(bars.predictions(spark, d), new, ["symbol", "interval", "ts"], ["actual_direction"]).select("symbol", "ts", "actual_direction")


@query(sql(f"""SELECT symbol, ts, {r('CAST(CASE WHEN symbol IN (SELECT symbol FROM predictions GROUP BY 1 HAVING avg(k) > 49.5) THEN 2 ELSE 1 END AS DOUBLE)', 'weight')}
    FROM candles_60"""))
def default_weights(spark, d):
    """Weights by symbol, 1 for symbols without one."""
    w = bars.predictions(spark, d).groupBy("symbol").agg(F.avg("k").alias("m")).where("m > 49.5").select("symbol", F.lit(2.0).alias("weight"))
    return scoring.with_default_weight(H(spark, d).select("symbol", "ts"), w)


@query(sql(f"""SELECT symbol, "interval", ts, CASE WHEN x > t THEN 'UP' WHEN x < -t THEN 'DOWN' ELSE 'FLAT' END AS direction FROM (SELECT symbol, "interval",
    ts, (close - open) / open AS x, 0.5 * CAST("interval" AS DOUBLE) / 60 AS t FROM (SELECT * FROM candles_60 UNION ALL SELECT * FROM candles_15))"""))
def interval_scaled_direction(spark, d):
    """Direction by a threshold in proportion to the interval's minutes; a bar that opens at 0 moves without bound, so its direction
    is UP (floats' inf and NaN both lie above any threshold)."""
    x = H(spark, d).unionByName(H(spark, d, 15))
    t = dataset.scaled_threshold(0.5, quality.minutes_of("interval"))
    return x.select("symbol", "interval", "ts", C.direction(C.float_ratio(F.col("close") - F.col("open"), F.col("open")), t).alias("direction"))


@query(sql("""SELECT "interval", count(*) AS candles, count(DISTINCT symbol) AS symbols FROM candles_60 GROUP BY 1"""))
def bulk_copy(spark, d):
    """A table copied twice into a partitioned store in the shared folder; the second copy adds nothing."""
    import uuid

    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    for _ in range(2):
        store.append_new(H(spark, d), path, ["symbol", "interval", "ts"], ["interval"])
    back = spark.read.parquet(path).withColumn("interval", F.col("interval").cast("string"))
    return back.groupBy("interval").agg(F.count(F.lit(1)).alias("candles"), F.countDistinct("symbol").alias("symbols"))
