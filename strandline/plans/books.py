"""Registered queries on order books, window plans, staging lags and the gates of an edge."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.columns import align_down, bars_for_hours
from strandline.operators import orderbook as O
from strandline.operators import state as S
from strandline.plans.common import AS_OF_TEXT, Market, as_of, query, rounded, sql
from strandline.plans.research import _EDGE, _edges

# Book texts made from each event: up to twelve levels a side, arrays and objects in turn, one in ten without a number.
_LEVEL = {
    "bids": ("CAST(round(value * 100) AS BIGINT) - (k * 7) % 13", "(event_id + k) % 9"),
    "asks": ("CAST(round(value * 100) AS BIGINT) + 1 + (k * 5) % 11", "(event_id + 2 * k) % 8"),
}


def _text(side: str, cast: str) -> str:
    price, size = _LEVEL[side]
    size = f"CASE WHEN (event_id + k) % 10 = 0 THEN 'x' ELSE CAST({size} AS {cast}) END"
    return f"CASE WHEN k % 2 = 0 THEN concat('[\"', CAST({price} AS {cast}), '\",\"', {size}, '\"]') ELSE concat('{{\"price\":\"', CAST({price} AS {cast}), '\",\"size\":\"', {size}, '\"}}') END"


def _made(side: str, engine: str) -> str:
    odd = "CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 'not json' ELSE concat('[', {}, ']') END AS " + side
    if engine == "spark":
        return odd.format(f"array_join(transform(sequence(0, CAST(event_id % 12 AS INT)), k -> {_text(side, 'STRING')}), ',')")
    return odd.format(f"array_to_string(list_transform(range(0, event_id % 12 + 1), lambda k: {_text(side, 'VARCHAR')}), ',')")


def _parsed(side: str, direction: str) -> str:
    number = lambda k, n: f"TRY_CAST(CASE WHEN json_type(x) = 'ARRAY' THEN x->>{k} ELSE x->>'{n}' END AS DOUBLE)"
    levels = f"list_transform(CASE WHEN json_valid({side}) THEN CAST({side} AS JSON[]) ELSE [] END, lambda x, i: {{'key': {'-' if direction == 'DESC' else ''}{number(0, 'price')}, 'i': i, 'price': {number(0, 'price')}, 'size': {number(1, 'size')}}})"
    return f"list_sort(list_filter({levels}, lambda v: v.price IS NOT NULL AND v.size IS NOT NULL))"


_BOOK = {"bt": f"SELECT event_id, {_made('bids', 'duckdb')}, {_made('asks', 'duckdb')} FROM events", "bp": f"SELECT event_id, coalesce({_parsed('bids', 'DESC')}, []) AS b, coalesce({_parsed('asks', 'ASC')}, []) AS a FROM bt"}
_sum = lambda side, n: f"coalesce(list_sum(list_transform({side}[1:{n}], lambda v: v.size)), 0.0)"


def _books(m: Market):
    text = m.table("events").selectExpr("event_id", _made("bids", "spark"), _made("asks", "spark"))
    return text.select("event_id", O.parse_levels(F.col("bids"), descending=True).alias("bids"), O.parse_levels(F.col("asks")).alias("asks"))


@query("order_book_parse", sql(f"""SELECT event_id, len(b) AS n_bids, len(a) AS n_asks, b[1].price AS best_bid, a[1].price AS best_ask, {_sum('b', 10)} AS bid_depth_10, {_sum('a', 10)} AS ask_depth_10,
    CASE WHEN len(b) > 0 AND len(a) > 0 THEN greatest(a[1].price - b[1].price, 0.0) ELSE 0.0 END AS spread, CASE WHEN len(b) > 0 AND len(a) > 0 THEN (a[1].price + b[1].price) / 2.0 END AS mid_price,
    CASE WHEN (a[1].price + b[1].price) / 2.0 > 0 THEN round(greatest(a[1].price - b[1].price, 0.0) / ((a[1].price + b[1].price) / 2.0) * 100.0, 9) + 0.0 END AS spread_pct FROM bp""", extra=_BOOK))
def order_book_parse(m: Market):
    top = O.top_of_book(_books(m).withColumns({"n_bids": F.size("bids").cast("long"), "n_asks": F.size("asks").cast("long")}))
    return top.select("event_id", "n_bids", "n_asks", "best_bid", "best_ask", "bid_depth_10", "ask_depth_10", "spread", "mid_price", (F.round("spread_pct", 9) + 0.0).alias("spread_pct"))


@query("book_metrics", sql(f"SELECT event_id, {_sum('b', 3)} AS bid_volume, {_sum('a', 3)} AS ask_volume, CASE WHEN {_sum('b', 3)} + {_sum('a', 3)} > 0 THEN round(({_sum('b', 3)} - {_sum('a', 3)}) / ({_sum('b', 3)} + {_sum('a', 3)}), 9) + 0.0 ELSE 0.0 END AS imbalance FROM bp", extra=_BOOK))
def book_metrics(m: Market):
    b, a = F.col("bids"), F.col("asks")
    return _books(m).select("event_id", O.volume(b, 3).alias("bid_volume"), O.volume(a, 3).alias("ask_volume"), (F.round(O.imbalance(b, a, 3), 9) + 0.0).alias("imbalance"))


# ---- window plans ----------------------------------------------------------------------------------

_BOUNDS = "SELECT exchange, symbol, date_trunc('second', min(time)) AS raw_start, time_bucket(INTERVAL '5 minutes', min(time) + INTERVAL 10 DAY) AS feature_start, time_bucket(INTERVAL '5 minutes', max(time) - INTERVAL 40 MINUTE) AS latest_finalized FROM trades GROUP BY 1, 2"
_NOW = f"TIMESTAMP '{AS_OF_TEXT}'"


def _bounds(m: Market):
    five = lambda t: align_down(t, 300_000)
    ten, forty = F.expr("INTERVAL 10 DAYS"), F.expr("INTERVAL 40 MINUTES")
    b = m.trades.groupBy("exchange", "symbol").agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    return b.select("exchange", "symbol", F.date_trunc("second", "lo").alias("raw_start"), five(F.col("lo") + ten).alias("feature_start"), five(F.col("hi") - forty).alias("latest_finalized"))


def _plan_sql(lo: str, hi: str, minutes: int, most: int) -> str:
    """DuckDB: [lo, hi) of ``bo`` in windows of ``minutes``, the newest ``most``."""
    return f"SELECT exchange, symbol, window_start, window_end, window_no FROM (SELECT exchange, symbol, s AS window_start, least(s + INTERVAL {minutes} MINUTE, hi) AS window_end, row_number() OVER (PARTITION BY exchange, symbol ORDER BY s DESC) AS window_no FROM (SELECT *, unnest(generate_series(lo, hi, INTERVAL {minutes} MINUTE)) AS s FROM (SELECT *, {lo} AS lo, {hi} AS hi FROM bo) WHERE lo < hi) WHERE s < hi) WHERE window_no <= {most}"


_B = {"bo": _BOUNDS}


@query("catch_up_windows", sql(_plan_sql(f"CASE WHEN greatest(raw_start, {_NOW} - INTERVAL 720 HOUR) < feature_start THEN greatest(raw_start, {_NOW} - INTERVAL 720 HOUR) END", f"least({_NOW}, feature_start + INTERVAL 180 MINUTE)", 360, 5), "trades", extra=_B))
def catch_up_windows(m: Market):
    return S.catch_up_windows(_bounds(m), as_of(), bootstrap_hours=720, overlap_minutes=180, chunk_hours=6, most=5)


_CUT = f"time_bucket(INTERVAL '5 minutes', {_NOW} - INTERVAL 8 MINUTE) + INTERVAL 5 MINUTE"


@query("frontier_windows", sql(_plan_sql("latest_finalized + INTERVAL 5 MINUTE", _CUT, 60, 4), "trades", extra=_B))
def frontier_windows(m: Market):
    return S.frontier_windows(_bounds(m), as_of(), overlap_minutes=180, lag_minutes=3, window_minutes=60, most=4)


_CURSOR = "feature_start"


@query("gap_repair_windows", sql(f"""SELECT exchange, symbol, window_start, window_end, CASE WHEN min(window_start) OVER k > lo THEN min(window_start) OVER k ELSE hi END AS next_cursor FROM
    (SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY window_end DESC) AS n FROM (SELECT *, max(CASE WHEN window_end <= {_CURSOR} THEN 1 ELSE 0 END) OVER (PARTITION BY exchange, symbol) AS ended FROM
    (SELECT *, s AS window_start, least(s + INTERVAL 720 MINUTE, hi) AS window_end FROM (SELECT *, unnest(generate_series(lo, hi, INTERVAL 720 MINUTE)) AS s FROM (SELECT *, raw_start AS lo, {_NOW} AS hi FROM bo) WHERE lo < hi) WHERE s < hi)) WHERE ended = 0 OR window_end <= {_CURSOR}) WHERE n <= 3 WINDOW k AS (PARTITION BY exchange, symbol)""", "trades", extra=_B))
def gap_repair_windows(m: Market):
    return S.gap_repair_windows(_bounds(m).withColumn("now", as_of()), "raw_start", "now", F.col("feature_start"), minutes=720, most=3).select("exchange", "symbol", "window_start", "window_end", "next_cursor")


@query("halved_windows", sql("SELECT exchange, symbol, h.s AS window_start, h.e AS window_end FROM (SELECT exchange, symbol, unnest(CASE WHEN d <= 30 OR d - greatest(d // 2, 30) <= 0 THEN [{'s': lo, 'e': hi}] ELSE [{'s': lo, 'e': lo + to_minutes(greatest(d // 2, 30))}, {'s': lo + to_minutes(greatest(d // 2, 30)), 'e': hi}] END) AS h FROM (SELECT *, raw_start AS lo, feature_start AS hi, CAST(floor((epoch(feature_start) - epoch(raw_start)) / 60) AS BIGINT) AS d FROM bo))", "trades", extra=_B))
def halved_windows(m: Market):
    return S.halve(_bounds(m), "raw_start", "feature_start", 30).select("exchange", "symbol", "window_start", "window_end")


@query("day_windows", sql("SELECT exchange, symbol, time_bucket(INTERVAL '1 day', raw_start) AS window_start, time_bucket(INTERVAL '1 day', feature_start - INTERVAL 1 MILLISECOND) + INTERVAL 1 DAY AS window_end, greatest(1, CAST(ceil((epoch(feature_start) - epoch(raw_start)) / 3600 / 4) AS BIGINT)) AS bars FROM bo", "trades", extra=_B))
def day_windows(m: Market):
    hours = (F.unix_timestamp("feature_start") - F.unix_timestamp("raw_start")) / 3600
    return S.expand_to_days(_bounds(m), "raw_start", "feature_start").select("exchange", "symbol", "window_start", "window_end", bars_for_hours(hours, 240).alias("bars"))


# ---- status lags and gates -------------------------------------------------------------------------


@query("status_lags", f"SELECT strategy_name, rows, filled, round(100.0 * filled / rows, 6) + 0.0 AS filled_pct, wide, round(100.0 * wide / rows, 6) + 0.0 AS wide_pct, lag_seconds FROM (SELECT o_orderpriority AS strategy_name, count(*) AS rows, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, count(*) FILTER (WHERE o_totalprice > 200000) AS wide, CAST(greatest(epoch({_NOW}) - epoch(max(CAST(o_orderdate AS TIMESTAMP))), 0) AS BIGINT) AS lag_seconds FROM orders GROUP BY 1)")
def status_lags(m: Market):
    o = m.table("orders").select(F.col("o_orderpriority").alias("strategy_name"), F.col("o_orderdate").cast("timestamp").alias("time"), "o_orderstatus", "o_totalprice")
    found = S.status_lags(o, ["strategy_name"], {"filled": F.col("o_orderstatus") == "F", "wide": F.col("o_totalprice") > 200000}, "time", as_of())
    return rounded(found)


_tail = lambda p: f"list_sort(list(edge))[CAST(floor((count(*) - 1) * {p}) AS BIGINT) + 1]"


@query("eligibility", sql(f"SELECT time, symbol, confidence >= 0.2 AS gate_confidence, trend_agreement >= 0 AS gate_agreement, edge >= hi OR edge <= lo AS gate_tail, abs(edge) >= 0 AS gate_edge, confidence >= 0.2 AND trend_agreement >= 0 AND (edge >= hi OR edge <= lo) AS eligible FROM ed JOIN (SELECT time, {_tail(0.25)} AS lo, {_tail(0.75)} AS hi FROM ed GROUP BY time) USING (time)", "gr", extra=_EDGE))
def eligibility(m: Market):
    from strandline.operators import research as R

    return R.eligible(_edges(m)).select("time", "symbol", "gate_confidence", "gate_agreement", "gate_tail", "gate_edge", "eligible")

