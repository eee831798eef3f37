"""Common table expressions of the derived market tables, for the SQL that checks the queries."""

from __future__ import annotations

import re

E = "SELECT event_type AS symbol, ts AS e_ts, event_id, user_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type FROM events"


def _candles(minutes: int, symbol: str = "event_type") -> str:
    return f"""SELECT {symbol} AS symbol, time_bucket(INTERVAL '{minutes} minutes', ts) AS ts, min_by(value, ts) AS open, max(value) AS high,
      min(value) AS low, max_by(value, ts) AS close, sum(value) AS volume, '{minutes}' AS "interval" FROM events GROUP BY ALL"""


def _probs(source: str, more: str = "") -> str:
    return f"""SELECT *, CASE WHEN prob_up >= 0.4 AND prob_up >= prob_down THEN 'UP' WHEN 0.4 >= prob_down THEN 'FLAT' ELSE 'DOWN' END AS direction
      FROM (SELECT *, 0.6 * (k + 0.5) / 100 AS prob_up, CAST(0.4 AS DOUBLE) AS prob_flat, 0.6 - 0.6 * (k + 0.5) / 100 AS prob_down, (k - 49.5)
      / 1000 AS magnitude FROM ({source}))"""


def _predictions(minutes: int) -> str:
    return _probs(f"""SELECT event_type AS symbol, time_bucket(INTERVAL '{minutes} minutes', ts) AS ts, '{minutes}' AS "interval",
      max_by(CAST(json_extract_string(props, '$.k') AS INTEGER), ts) AS k FROM events GROUP BY ALL""")


CTES = {
    "e": E,
    "candles_60": _candles(60),
    "candles_15": _candles(15),
    "candles_user": _candles(1440, "'U' || user_id"),
    "candles_raw": """SELECT symbol, ts, "interval", open, CASE WHEN r % 89 = 0 THEN low ELSE high END AS high, CASE WHEN r % 89 = 0 THEN high ELSE low
        END AS low,
      CASE WHEN r % 97 = 0 THEN -close ELSE close END + d AS close, CASE WHEN r % 83 = 0 THEN -volume ELSE volume END AS volume, r, d AS arrival
      FROM (SELECT *, row_number() OVER (ORDER BY symbol, ts) AS r FROM candles_60) CROSS JOIN (VALUES (0), (1)) AS dup(d) WHERE d = 0 OR r % 71 = 0""",
    "predictions": _predictions(60),
    "predictions_15": _predictions(15),
    "model_predictions": _probs("""SELECT symbol, ts, "interval", (k * 7 + 13 * m) % 100 AS k, 'm' || m AS model FROM (SELECT symbol, ts, "interval", k
        FROM predictions) CROSS JOIN (VALUES (0), (1), (2)) AS ms(m)"""),
    "order_book": """SELECT * FROM (SELECT symbol, time_bucket(INTERVAL '60 minutes', e_ts) AS ts,
      list(value ORDER BY e_ts) FILTER (WHERE event_id % 2 = 0)[1:15] AS bid_vols, list(value ORDER BY e_ts) FILTER (WHERE event_id % 2 = 1)[1:15] AS ask_vols
      FROM e GROUP BY ALL) WHERE len(bid_vols) > 0 AND len(ask_vols) > 0""",
    "funding": "SELECT symbol, time_bucket(INTERVAL '480 minutes', e_ts) AS ts, (avg(k) - 49.5) / 50000 AS funding_rate, max(value) + 1 AS mark_price, min(value) + 1 AS last_price FROM e GROUP BY ALL",
    "funding_b": "SELECT symbol, time_bucket(INTERVAL '360 minutes', e_ts) AS ts, (avg(k) - 49.5) / 50000 AS funding_rate, max(value) + 1 AS mark_price, min(value) + 1 AS last_price FROM e GROUP BY ALL",
    "derivatives": """SELECT symbol, time_bucket(INTERVAL '60 minutes', e_ts) AS ts, CAST(sum(k) AS DOUBLE) AS oi_close, coalesce(sum(value)
        FILTER (WHERE k < 50), 0) AS long_vol,
      coalesce(sum(value) FILTER (WHERE k >= 50), 0) AS short_vol, (1 + count(*) FILTER (WHERE k < 50)) / (1 + count(*) FILTER (WHERE k >= 50)) AS ratio FROM e
      GROUP BY ALL""",
    "fear_greed": "SELECT time_bucket(INTERVAL '1440 minutes', e_ts) AS ts, avg(k) AS value FROM e GROUP BY ALL",
    "news": """SELECT 'U' || (user_id % 20) AS symbol, time_bucket(INTERVAL '60 minutes', e_ts) AS ts, count(*) FILTER (WHERE event_type = 'purchase')
        AS positive,
      count(*) FILTER (WHERE event_type = 'error') AS negative, count(*) FILTER (WHERE event_type = 'view') AS neutral,
      count(*) FILTER (WHERE event_type IN ('purchase', 'error', 'view')) AS total FROM e GROUP BY ALL""",
    "trades": """SELECT o_orderdate AS entry, l_shipdate AS exit, CASE WHEN l_linestatus = 'O' THEN 'LONG' ELSE 'SHORT' END AS side,
        l_extendedprice AS notional,
      l_extendedprice * (l_discount - l_tax) AS net_pnl, l_extendedprice * 0.0022 AS costs FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      WHERE l_shipdate >= o_orderdate""",
    "equity": "SELECT ts, 1e9 + sum(pnl) OVER (ORDER BY ts) AS equity FROM (SELECT exit AS ts, sum(net_pnl) AS pnl FROM trades GROUP BY exit)",
    "scored": """SELECT p.symbol, p."interval", p.ts, p.direction, p.prob_up, p.prob_flat, p.prob_down, p.magnitude, p.k, (c.next_close - c.close)
        / c.close AS actual_magnitude,
      CASE WHEN (c.next_close - c.close) / c.close > 0.5 THEN 'UP' WHEN (c.next_close - c.close) / c.close < -0.5 THEN 'DOWN' ELSE 'FLAT'
      END AS actual_direction, c.next_ts AS scored_at
      FROM predictions p JOIN (SELECT *, lead(close) OVER (PARTITION BY symbol, "interval" ORDER BY ts) AS next_close, lead(ts) OVER (PARTITION BY symbol,
      "interval" ORDER BY ts) AS next_ts FROM candles_60) c
      ON p.symbol = c.symbol AND p."interval" = c."interval" AND p.ts = c.ts WHERE c.close <> 0 AND c.next_close IS NOT NULL""",
}


def sql(body: str, recursive: bool = False) -> str:
    """body with the expressions that it names, and those that they name, before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if re.search(rf"\b{name}\b(?!\s*\.|')", text) and re.search(rf"(?:FROM|JOIN)\s+{name}\b", text) and name not in order:
                need(CTES[name])
                order.append(name)

    need(body)
    own = body.strip()
    with_ = ", ".join(f"{n} AS ({CTES[n]})" for n in order)
    if own.upper().startswith("WITH "):
        return f"WITH {'RECURSIVE ' if recursive else ''}{with_}{', ' if with_ else ''}{own[5:]}"
    return f"WITH {with_} {own}" if with_ else own


KEYS = 'symbol, "interval"'
S = f"PARTITION BY {KEYS} ORDER BY ts"


def w(n: int, key: str = KEYS) -> str:
    return f"(PARTITION BY {key} ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, least: int | None = None, key: str = KEYS) -> str:
    return f"(CASE WHEN count({x}) OVER {w(n, key)} >= {n if least is None else least} THEN {agg}({x}) OVER {w(n, key)} END)"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif(({b}), 0))"


def lag(x: str, k: int = 1, key: str = KEYS) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY {key} ORDER BY ts)"


def pct(x: str, k: int = 1, key: str = KEYS) -> str:
    return f"(({x} - {lag(x, k, key)}) / nullif({lag(x, k, key)}, 0))"


def z(x: str, n: int, least: int | None = None, key: str = KEYS) -> str:
    sd = roll("stddev_samp", x, n, least, key)
    return f"(CASE WHEN {sd} > 1e-12 THEN ({x} - {roll('avg', x, n, least, key)}) / {sd} END)"


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


CONVICTION = "greatest(0.0, 1 - (-(prob_up * ln(prob_up) + prob_flat * ln(prob_flat) + prob_down * ln(prob_down))) / ln(3))"
