"""Registered queries on keyed rows: late refresh, last row of a key, issue order, universe rows and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import bars as B
from strandline.operators import costs as C
from strandline.operators import health as H
from strandline.operators import state as S
from strandline.operators import universe as U
from strandline.plans.common import Market, query, rounded, rr, sql
from strandline.plans.market import _EVAL, _HEALTH, _TH, _symbols

_KEYS = ["time", "symbol", "exchange"]
_VALUES = ["open", "high", "low", "close", "volume", "num_trades"]
_SEEN, _SINCE, _AS_OF = "2024-01-20 00:00:00", "2024-01-15 00:00:00", "2024-01-20 03:00:00"
_STORED_FINAL = f"time + INTERVAL 1 HOUR + INTERVAL 3 MINUTE <= TIMESTAMP '{_SEEN}'"
_FRESH_FINAL = f"time + INTERVAL 1 HOUR + INTERVAL 4320 MINUTE <= TIMESTAMP '{_AS_OF}'"
_OHLC = "arg_min(price, t) AS open, max(price) AS high, min(price) AS low, arg_max(price, t) AS close, sum(size) AS volume, count(*) AS num_trades"
_LATE = {
    "st": f"SELECT time_bucket(INTERVAL '1 hour', t) AS time, symbol, exchange, {_OHLC} FROM (SELECT symbol, exchange, price, size, time AS t FROM trades WHERE side = 'buy') GROUP BY ALL",
    "fr": f"SELECT time_bucket(INTERVAL '1 hour', t) AS time, symbol, exchange, {_OHLC} FROM (SELECT symbol, exchange, price, size, time AS t FROM trades) WHERE t >= TIMESTAMP '{_SINCE}' GROUP BY ALL",
}


@query("late_refresh", sql(f"""SELECT time, symbol, exchange, num_trades, final AS is_finalized, NOT final AS is_provisional, CASE WHEN was THEN TIMESTAMP '{_SEEN}' WHEN final THEN TIMESTAMP '{_AS_OF}' END AS finalized_at, {rr('open', 'high', 'low', 'close', 'volume')} FROM
    (SELECT time, symbol, exchange, {', '.join(f'CASE WHEN fr.num_trades IS NOT NULL THEN fr.{c} ELSE st.{c} END AS {c}' for c in _VALUES)}, st.num_trades IS NOT NULL AND {_STORED_FINAL} AS was, (st.num_trades IS NOT NULL AND {_STORED_FINAL}) OR (fr.num_trades IS NOT NULL AND {_FRESH_FINAL}) AS final FROM st FULL JOIN fr USING (time, symbol, exchange))""", "trades", extra=_LATE))  # fmt: skip
def late_refresh(m: Market):
    """Bars stored before the sells came in, and refreshed with them under a longer wait."""
    at = lambda x: F.lit(x).cast("timestamp")
    stored = B.finality(B.candles(m.trades.filter("side = 'buy'"), "1 hour"), at(_SEEN), "1 HOUR", 3)
    fresh = B.finality(B.candles(m.trades, "1 hour"), at(_AS_OF), "1 HOUR", 4320)
    made = S.refresh(stored, fresh, _KEYS, _VALUES, at(_SINCE))
    return rounded(made.select(*_KEYS, *_VALUES, "is_finalized", "is_provisional", "finalized_at"))


@query("last_wins", sql("SELECT time, symbol, exchange, arg_max(price, CAST(trade_id AS BIGINT)) AS price, max(CAST(trade_id AS BIGINT)) AS n FROM (SELECT time_bucket(INTERVAL '1 hour', t) AS time, symbol, exchange, price, trade_id FROM (SELECT *, time AS t FROM trades)) GROUP BY ALL", "trades"))
def last_wins(m: Market):
    rows = m.trades.select(B.bucket("time", "1 hour").alias("time"), "symbol", "exchange", "price", F.col("trade_id").cast("long").alias("n"))
    return S.last_wins(rows, _KEYS, "n")


@query("health_issues", sql(f"SELECT exchange, symbol, status FROM e3 WHERE status <> 'HEALTHY' ORDER BY CASE status {' '.join(f'''WHEN '{s}' THEN {r}''' for s, r in H.ISSUE_RANK.items())} END, feature_lag_seconds DESC NULLS LAST, candle_5m_raw_lag_seconds DESC NULLS LAST, exchange, symbol LIMIT 500", "sync", "b5", extra=_EVAL))
def health_issues(m: Market):
    return H.issues(H.evaluate(_symbols(m), _TH), 500).select("exchange", "symbol", "status")


@query("universe_breakdown", sql("SELECT kind, symbols FROM (SELECT count(*) FILTER (WHERE coverage_ratio >= 0.98) AS deep, count(*) FILTER (WHERE coverage_ratio BETWEEN 0.5 AND 0.98) AS core, count(*) FILTER (WHERE active_recent) AS tradable, count(*) FILTER (WHERE coverage_ratio < 0.5) AS fragile FROM h) UNPIVOT (symbols FOR kind IN (deep, core, tradable, fragile))", "sync", "b5", extra=_HEALTH))
def universe_breakdown(m: Market):
    return C.universe_breakdown(_symbols(m))


@query("full_universe", "WITH u AS (SELECT DISTINCT o_orderpriority AS exchange, CAST(o_custkey AS VARCHAR) AS symbol FROM orders), r AS (SELECT o_orderpriority AS exchange, CAST(o_custkey AS VARCHAR) AS symbol, count(*) AS rows FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) SELECT exchange, symbol, coalesce(rows, 0) AS rows FROM u LEFT JOIN r USING (exchange, symbol)")
def full_universe(m: Market):
    o = m.table("orders").select(F.col("o_orderpriority").alias("exchange"), F.col("o_custkey").cast("string").alias("symbol"), "o_orderstatus")
    rows = o.filter("o_orderstatus = 'F'").groupBy("exchange", "symbol").agg(F.count("*").alias("rows"))
    return H.full_universe(o.select("exchange", "symbol").distinct(), rows, {"rows": 0})


@query("distinct_candidates", sql("SELECT symbol, '5m' AS interval, time_bucket(INTERVAL '5 minutes', time) AS start FROM trades GROUP BY ALL", "trades"))
def distinct_candidates(m: Market):
    return U.distinct_candidates(m.trades.select("symbol", F.lit("5m").alias("interval"), B.bucket("time", "5 minutes").alias("start")))
