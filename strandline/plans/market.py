"""Registered queries on market data: bars, reads, rankings, state, gaps and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.columns import bucket
from strandline.operators import bars as B
from strandline.operators import features as X
from strandline.operators import health as H
from strandline.operators import research as R
from strandline.operators import state as S
from strandline.plans.common import AS_OF_TEXT, START_TEXT, Market, as_of, query, r, rounded, rr, sql, start
from strandline.sources import io
from strandline.sources.scratch import stored

T = f"TIMESTAMP '{AS_OF_TEXT}'"
T0 = f"TIMESTAMP '{START_TEXT}'"
_M1T = ["trade_volume", "buy_volume", "sell_volume", "trade_notional"]


@query("bars_1m_trades", sql(f"SELECT time, symbol, exchange, trade_count, last_event_time, {rr(*_M1T)} FROM m1t", "m1t"))
def bars_1m_trades(m: Market):
    return rounded(B.minute_trades(m.trades))


@query("bars_1m_book", sql(f"SELECT time, symbol, exchange, orderbook_samples, last_event_time, {rr(*B.BOOK)} FROM m1b", "m1b"))
def bars_1m_book(m: Market):
    return rounded(B.minute_books(m.books))


@query("bars_1m_context", sql(f"SELECT time, symbol, exchange, last_event_time, {rr('funding_rate', 'open_interest')} FROM m1c", "m1c"))
def bars_1m_context(m: Market):
    return rounded(B.minute_context(m.context))


_B5 = ["open", "high", "low", "close", "volume", "trade_volume", "buy_volume", "sell_volume", "trade_vwap", "best_bid", "best_ask", "spread", "spread_pct", "mid_price", "bid_depth_10", "ask_depth_10", "funding_rate", "open_interest"]
_B5X = "time, symbol, exchange, num_trades, trade_count, orderbook_samples, candle_observed, trade_observed, orderbook_observed, asset_context_observed, is_provisional, is_finalized, finalization_due_at, finalized_at"


@query("bars_5m", sql(f"SELECT {_B5X}, {rr(*_B5)} FROM b5", "b5"))
def bars_5m(m: Market):
    return rounded(m.bars_5m)


_PD = ["open", "high", "low", "close", "volume", "trade_volume", "buy_volume", "sell_volume", "trade_vwap", "spread_bps", "depth_usd", "funding_rate", "open_interest", "trade_observed_ratio", "orderbook_observed_ratio", "asset_context_observed_ratio"]
_PDX = "time, symbol, exchange, num_trades, trade_count, candle_minutes, trade_minutes, orderbook_minutes, asset_context_minutes, is_provisional, is_finalized, finalization_due_at, finalized_at"
_DAY = "time_bucket(INTERVAL '1 day', x.time) AS time, symbol, exchange"
_D_FINAL = f"c.time + INTERVAL 1 DAY + INTERVAL 3 MINUTE <= {T}"
_DAILY = {
    "dc": f"SELECT {_DAY}, arg_min(open, x.time) AS open, max(high) AS high, min(low) AS low, arg_max(close, x.time) AS close, sum(volume) AS volume, CAST(sum(num_trades) AS BIGINT) AS num_trades, count(*) AS candle_bars FROM c4h x GROUP BY 1, 2, 3",
    "de": f"""SELECT {_DAY}, sum(trade_volume) AS trade_volume, sum(buy_volume) AS buy_volume, sum(sell_volume) AS sell_volume, CAST(sum(trade_count) AS BIGINT) AS trade_count,
        CASE WHEN sum(trade_volume) > 0 THEN sum(coalesce(trade_vwap, 0) * trade_volume) / sum(trade_volume) END AS trade_vwap, avg(CASE WHEN spread_pct > 0 THEN spread_pct * 10000.0 END) AS spread_bps,
        avg((bid_depth_10 + ask_depth_10) / 2.0 * mid_price) AS depth_usd, avg(funding_rate) AS funding_rate, avg(open_interest) AS open_interest, {', '.join(f"avg(CASE WHEN {x}_observed THEN 1.0 ELSE 0.0 END) AS {x}_ratio, count(*) FILTER (WHERE {x}_observed) AS {x}_bars" for x in ('trade', 'orderbook', 'asset_context'))} FROM b5 x GROUP BY 1, 2, 3""",
    "df": f"SELECT {_DAY}, avg(funding_rate) AS funding_rate, avg(open_interest) AS open_interest FROM context x GROUP BY 1, 2, 3",
    "pd": f"""SELECT c.time, c.symbol, c.exchange, c.open, c.high, c.low, c.close, c.volume, c.num_trades, coalesce(e.trade_volume, 0.0) AS trade_volume, coalesce(e.buy_volume, 0.0) AS buy_volume, coalesce(e.sell_volume, 0.0) AS sell_volume, coalesce(e.trade_count, 0) AS trade_count, e.trade_vwap, e.spread_bps, e.depth_usd,
        coalesce(f.funding_rate, e.funding_rate) AS funding_rate, coalesce(f.open_interest, e.open_interest) AS open_interest, {', '.join(f'coalesce(e.{x}_ratio, 0.0) AS {x}_observed_ratio, coalesce(e.{x}_bars, 0) * 5 AS {x}_minutes' for x in ('trade', 'orderbook', 'asset_context'))},
        c.candle_bars * 240 AS candle_minutes, NOT ({_D_FINAL}) AS is_provisional, {_D_FINAL} AS is_finalized, c.time + INTERVAL 1 DAY + INTERVAL 3 MINUTE AS finalization_due_at, CASE WHEN {_D_FINAL} THEN {T} END AS finalized_at
        FROM dc c LEFT JOIN de e USING (time, symbol, exchange) LEFT JOIN df f USING (time, symbol, exchange)""",
}


def _twice(columns: list[str]) -> list[str]:
    """To nine digits first, so that averages that end in a tie round alike in both engines."""
    parts = [c.rpartition(" AS ") for c in columns]
    return [f"round({e or n}, 9) AS {n}" for e, _, n in parts]


@query("panel_daily", sql(f"SELECT {_PDX}, {rr(*_twice(_PD))} FROM pd", "c4h", "b5", "context", extra=_DAILY))
def panel_daily(m: Market):
    return rounded(rounded(m.panel_daily, 9))


@query("panel_rebucket", sql(f"SELECT time_bucket(INTERVAL '30 minutes', x.time) AS time, symbol, exchange, {rr('arg_min(open, x.time) AS open', 'max(high) AS high', 'min(low) AS low', 'arg_max(close, x.time) AS close', 'sum(volume) AS volume', 'avg(spread) AS spread', 'avg(funding_rate) AS funding_rate', 'avg(open_interest) AS open_interest')}, count(*) AS bars FROM b5 x WHERE is_finalized GROUP BY 1, 2, 3", "b5"))
def panel_rebucket(m: Market):
    return rounded(B.rebucket(m.bars_5m, 30))


@query("ohlc_4h", sql(f"SELECT time, symbol, exchange, num_trades, {rr('open', 'high', 'low', 'close', 'volume')} FROM c4h", "c4h"))
def ohlc_4h(m: Market):
    return rounded(m.candles_4h)


@query("carry_1d", sql(f"SELECT time_bucket(INTERVAL '1 day', x.time) AS time, symbol, {rr('avg(funding_rate) AS funding_rate', 'avg(open_interest) AS open_interest')} FROM context x GROUP BY 1, 2", "context"))
def carry_1d(m: Market):
    return rounded(B.carry(m.context, "1 day"))


@query("liquid_universe", sql(f"SELECT symbol, {rr('avg(close * volume) AS notional')} FROM c1h GROUP BY symbol ORDER BY avg(close * volume) DESC, symbol LIMIT 3", "c1h"))
def liquid_universe(m: Market):
    return rounded(B.liquid_universe(m.candles_1h, 3))


@query("liquid_bars", sql(f"SELECT time, symbol, exchange, {rr('close')} FROM c1h WHERE symbol IN (SELECT symbol FROM c1h GROUP BY symbol ORDER BY avg(close * volume) DESC, symbol LIMIT 3)", "c1h"))
def liquid_bars(m: Market):
    return B.keep_symbols(m.candles_1h, B.liquid_universe(m.candles_1h, 3)).select("time", "symbol", "exchange", r("close").alias("close"))


@query("volume_stats", sql(f"SELECT symbol, trade_count, {rr('total_volume', 'buy_volume', 'sell_volume', 'avg_price', 'buy_volume * 100 / total_volume AS buy_pct', 'sell_volume * 100 / total_volume AS sell_pct')} FROM (SELECT symbol, count(*) AS trade_count, sum(size) AS total_volume, sum(CASE WHEN side = 'buy' THEN size ELSE 0 END) AS buy_volume, sum(CASE WHEN side = 'sell' THEN size ELSE 0 END) AS sell_volume, avg(price) AS avg_price FROM trades GROUP BY symbol)", "trades"))
def volume_stats(m: Market):
    return rounded(B.volume_stats(m.trades))


@query("bucket_series", sql(f"SELECT time_bucket(INTERVAL '15 minutes', x.time) AS bucket, symbol, {rr('avg(price) AS avg_price', 'max(price) AS max_price')}, count(DISTINCT exchange) AS venues, {rr(*[f'''sum(CASE WHEN side = '{s}' THEN price * size ELSE 0 END) AS {s}_notional''' for s in ('buy', 'sell')])} FROM trades x GROUP BY 1, 2", "trades"))
def bucket_series(m: Market):
    notional = lambda s: F.sum(F.when(F.col("side") == s, F.col("price") * F.col("size")).otherwise(0.0))
    return rounded(B.bucket_series(m.trades, "time", "15 minutes", ["symbol"], avg_price=F.avg("price"), max_price=F.max("price"), venues=F.count_distinct("exchange"), buy_notional=notional("buy"), sell_notional=notional("sell")))


# ---- reads -----------------------------------------------------------------------------------------


@query("latest_candle", sql(f"SELECT symbol, exchange, max(time) AS time, {rr('arg_max(close, c.time) AS close', 'arg_max(volume, c.time) AS volume')} FROM c1h c GROUP BY symbol, exchange", "c1h"))
def latest_candle(m: Market):
    return rounded(io.latest(m.candles_1h, ["symbol", "exchange"]).select("symbol", "exchange", "time", "close", "volume"))


@query("candle_page", sql(f"SELECT time, exchange, {rr('close')} FROM c1h WHERE symbol = 'click' AND exchange = 'ex0' AND time >= TIMESTAMP '2024-01-05' AND time <= TIMESTAMP '2024-01-25' ORDER BY time DESC LIMIT 100", "c1h"))
def candle_page(m: Market):
    at = lambda s: F.lit(s).cast("timestamp")
    return rounded(io.newest(m.candles_1h.filter("exchange = 'ex0'"), "click", at("2024-01-05"), at("2024-01-25"), 100).select("time", "exchange", "close"))


@query("scan_range", sql("SELECT symbol, count(*) AS n FROM trades WHERE time >= TIMESTAMP '2024-01-10' AND time < TIMESTAMP '2024-01-20' AND exchange = 'ex1' GROUP BY symbol", "trades"))
def scan_range(m: Market):
    at = lambda s: F.lit(s).cast("timestamp")
    return io.scan(m.trades, at("2024-01-10"), at("2024-01-20"), exchange="ex1").groupBy("symbol").agg(F.count("*").alias("n"))


@query("current_book", sql(f"SELECT symbol, exchange, time, {rr('best_bid', 'best_ask')} FROM (SELECT symbol, exchange, last_event_time AS time, best_bid, best_ask, 1 AS p FROM m1b UNION ALL SELECT symbol, exchange, time, best_bid, best_ask, 0 FROM books) QUALIFY row_number() OVER (PARTITION BY symbol, exchange ORDER BY time DESC, p DESC) = 1", "m1b"))
def current_book(m: Market):
    return rounded(io.newer_of(B.minute_books(m.books), m.books, ["symbol", "exchange"], ["best_bid", "best_ask"]))


@query("latest_funding", sql(f"SELECT symbol, exchange, time, {rr('funding_rate', 'open_interest')} FROM (SELECT symbol, exchange, last_event_time AS time, funding_rate, open_interest, 1 AS p FROM m1c UNION ALL SELECT symbol, exchange, time, funding_rate, open_interest, 0 FROM context) QUALIFY row_number() OVER (PARTITION BY symbol, exchange ORDER BY time DESC, p DESC) = 1", "m1c"))
def latest_funding(m: Market):
    return rounded(io.newer_of(B.minute_context(m.context), m.context, ["symbol", "exchange"], ["funding_rate", "open_interest"]))


@query("latest_sentiment", sql(f"SELECT observed_at, symbol, source, {rr('sentiment_score', 'confidence')} FROM sentiment WHERE symbol IN ('view', 'click', 'error') AND observed_at >= TIMESTAMP '2024-01-02' ORDER BY observed_at DESC LIMIT 1", "sentiment"))
def latest_sentiment(m: Market):
    return rounded(io.latest_candidates(m.sentiment, ["view", "click"], "error", F.lit("2024-01-02").cast("timestamp"), "observed_at").select("observed_at", "symbol", "source", "sentiment_score", "confidence"))


# ---- rankings --------------------------------------------------------------------------------------

_SENT = "SELECT symbol, avg(sentiment_score) AS sentiment_score, avg(confidence) AS sentiment_confidence FROM sentiment GROUP BY symbol"
_RANGE = "SELECT symbol, coalesce((max(close) - min(close)) / nullif(min(close), 0), 0) AS return_ratio, count(*) FILTER (WHERE close > prev) / count(*) AS up_ratio, coalesce(stddev_pop(CASE WHEN prev IS NOT NULL THEN (close - prev) / nullif(prev, 0) ELSE 0 END), 0) AS realized_vol FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY time) AS prev FROM x1) GROUP BY symbol"
_X1 = "SELECT * FROM c1h WHERE exchange = 'ex0'"


@query("alpha_candidates", sql(f"SELECT symbol, {rr('return_ratio', 'up_ratio', 'sentiment_score', 'sentiment_confidence', 'return_ratio * 100 + up_ratio * 25 + sentiment_score * 20 + sentiment_confidence * 5 AS alpha_score')} FROM (SELECT m.*, coalesce(s.sentiment_score, 0) AS sentiment_score, coalesce(s.sentiment_confidence, 0) AS sentiment_confidence FROM mo m LEFT JOIN se s ON s.symbol = split_part(m.symbol, '-', 1)) ORDER BY alpha_score DESC, symbol LIMIT 20", "c1h", "sentiment", extra={"x1": _X1, "mo": _RANGE, "se": _SENT}))
def alpha_candidates(m: Market):
    return rounded(R.alpha_candidates(m.candles_1h.filter("exchange = 'ex0'"), m.sentiment))


@query("trade_setups", sql(f"""SELECT symbol, trade_count, CASE WHEN setup_score >= 0 THEN 'BUY' ELSE 'SELL' END AS suggested_side, CASE WHEN return_ratio >= 0.01 AND up_ratio >= 0.55 THEN 'BULL_TREND' WHEN return_ratio <= -0.01 AND up_ratio <= 0.45 THEN 'BEAR_TREND' ELSE 'RANGE' END AS regime,
    {rr('return_ratio', 'up_ratio', 'realized_vol', 'avg_trade_size', 'avg_spread_pct', 'sentiment_score', 'sentiment_confidence', 'setup_score')} FROM (SELECT *, return_ratio * 100 + up_ratio * 20 + sentiment_score * 20 + sentiment_confidence * 5 - realized_vol * 300 - avg_spread_pct * 0.75 AS setup_score FROM
    (SELECT m.*, t.trade_count, t.avg_trade_size, coalesce(b.s, 0) AS avg_spread_pct, coalesce(s.sentiment_score, 0) AS sentiment_score, coalesce(s.sentiment_confidence, 0) AS sentiment_confidence FROM mo m JOIN (SELECT symbol, count(*) AS trade_count, avg(size) AS avg_trade_size FROM trades GROUP BY symbol) t USING (symbol) LEFT JOIN (SELECT symbol, avg(spread_pct) AS s FROM books GROUP BY symbol) b USING (symbol) LEFT JOIN se s USING (symbol) WHERE t.trade_count >= 50)) ORDER BY setup_score DESC, symbol LIMIT 10""", "c1h", "sentiment", "books", extra={"x1": _X1, "mo": _RANGE, "se": _SENT}))
def trade_setups(m: Market):
    return rounded(R.trade_setups(m.candles_1h.filter("exchange = 'ex0'"), m.trades, m.books, m.sentiment))


@query("venue_mux", sql(f"""SELECT symbol, exchange_count, total_bars, {rr('cross_spread_pct', 'total_vol', 'avg_momentum', 'sentiment', 'cross_spread_pct * 60 + avg_momentum * 25 + sentiment * 15 + ln(1 + greatest(total_vol, 0)) * 2 AS mux_score')} FROM
    (SELECT q.*, coalesce(s.sentiment_score, 0) AS sentiment FROM (SELECT symbol, count(*) AS exchange_count, coalesce((max(px) - min(px)) / nullif(min(px), 0), 0) AS cross_spread_pct, sum(vol) AS total_vol, CAST(sum(bars) AS BIGINT) AS total_bars, avg(mom) AS avg_momentum FROM px GROUP BY symbol) q LEFT JOIN se s ON s.symbol = split_part(q.symbol, '-', 1))""", "c1h", "sentiment", extra={"se": _SENT, "px": "SELECT exchange, symbol, max(close) AS px, coalesce(sum(CASE WHEN prev IS NOT NULL THEN (close - prev) / nullif(prev, 0) ELSE 0 END), 0) AS mom, sum(volume) AS vol, count(*) AS bars FROM (SELECT *, lag(close) OVER (PARTITION BY exchange, symbol ORDER BY time) AS prev FROM c1h) GROUP BY exchange, symbol"}))
def venue_mux(m: Market):
    return rounded(R.venue_mux(m.candles_1h, m.sentiment))


@query("momentum_rank", sql(f"""SELECT symbol, {rr('close', 'mom_short', 'mom_long', 'vol', 'coalesce(s.roll, 0) AS sentiment', '(mom_short * 0.4 + mom_long * 0.6) / vol + coalesce(s.roll, 0) * 0.75 AS alpha_score')} FROM
    (SELECT symbol, close, mom_short, mom_long, CASE WHEN k240 = 48 AND v > 0 THEN v ELSE 1e-6 END AS vol FROM (SELECT *, stddev_samp(ret) OVER w AS v, count(ret) OVER w AS k240 FROM p WINDOW w AS (PARTITION BY symbol ORDER BY time ROWS 47 PRECEDING)) WHERE k = n AND n >= 24) l LEFT JOIN ss s USING (symbol)""", "c1h", "sentiment", extra={
    "x1": _X1,
    "p": "SELECT symbol, time, close, coalesce(close / nullif(lag(close) OVER w, 0) - 1, 0) AS ret, close / nullif(lag(close, 6) OVER w, 0) - 1 AS mom_short, close / nullif(lag(close, 48) OVER w, 0) - 1 AS mom_long, row_number() OVER w AS k, count(*) OVER (PARTITION BY symbol) AS n FROM x1 WINDOW w AS (PARTITION BY symbol ORDER BY time)",
    "ss": "SELECT symbol, roll FROM (SELECT symbol, avg(sentiment_score) OVER (PARTITION BY symbol ORDER BY observed_at, source ROWS 19 PRECEDING) AS roll, row_number() OVER (PARTITION BY symbol ORDER BY observed_at DESC, source DESC) AS k FROM sentiment) WHERE k = 1",
}))
def momentum_rank(m: Market):
    return rounded(R.momentum_rank(m.candles_1h.filter("exchange = 'ex0'"), m.sentiment, short=6, long=48, least=24).drop("n", "k"))


@query("top_bottom", sql("SELECT exchange, symbol, side, rank FROM (SELECT exchange, symbol, 'top' AS side, row_number() OVER (PARTITION BY exchange ORDER BY round(v, 6) DESC, symbol) AS rank FROM t UNION ALL SELECT exchange, symbol, 'bottom', row_number() OVER (PARTITION BY exchange ORDER BY round(v, 6), symbol) FROM t) WHERE rank <= 2", "c1h", extra={"t": "SELECT exchange, symbol, avg(close) AS v FROM c1h GROUP BY exchange, symbol"}))
def top_bottom(m: Market):
    from pyspark.sql import Window

    t = m.candles_1h.groupBy("exchange", "symbol").agg(F.round(F.avg("close"), 6).alias("v"))
    w = Window.partitionBy("exchange")
    ranked = t.withColumns({"top": F.row_number().over(w.orderBy(F.desc("v"), "symbol")), "bottom": F.row_number().over(w.orderBy("v", "symbol"))})
    return ranked.unpivot(["exchange", "symbol"], ["top", "bottom"], "side", "rank").filter("rank <= 2")


# ---- state -----------------------------------------------------------------------------------------


@query("sync_state", sql("SELECT * FROM sync", "sync"))
def sync_state(m: Market):
    return m.sync


@query("coverage_state", sql(f"""SELECT exchange, symbol, lo AS earliest_raw_time, hi AS latest_raw_time, expected_bars, observed_bars, finalized_bars, {rr('least(observed_bars / expected_bars, 1.0) AS coverage_ratio', 'least(finalized_bars / expected_bars, 1.0) AS finalized_ratio')} FROM
    (SELECT *, CAST((epoch(time_bucket(INTERVAL '5 minutes', hi)) - epoch(time_bucket(INTERVAL '5 minutes', lo))) / 300 AS BIGINT) + 1 AS expected_bars FROM (SELECT exchange, symbol, min(earliest_raw_time) AS lo, max(latest_raw_time) AS hi FROM sync GROUP BY 1, 2) JOIN (SELECT exchange, symbol, count(*) AS observed_bars, count(*) FILTER (WHERE is_finalized) AS finalized_bars FROM b5 GROUP BY 1, 2) USING (exchange, symbol))""", "sync", "b5"))
def coverage_state(m: Market):
    return rounded(S.coverage_state(m.sync, m.bars_5m, 5))


@query("materialisation_state", sql("SELECT exchange, symbol, min(time) AS earliest_feature_time, max(time) AS latest_feature_time, max(time) FILTER (WHERE is_finalized) AS finalized_through, count(*) AS feature_rows, count(*) FILTER (WHERE is_finalized) AS finalized_bars FROM b5 GROUP BY 1, 2", "b5"))
def materialisation_state(m: Market):
    return S.materialisation_state(m.bars_5m)


@query("distinct_bucket_cov", sql(f"SELECT exchange, symbol, count(DISTINCT time) AS buckets, {rr('count(DISTINCT time) / 8640 AS coverage')} FROM b5 GROUP BY 1, 2", "b5"))
def distinct_bucket_cov(m: Market):
    return rounded(S.distinct_coverage(m.bars_5m, 30 * 288))


@query("repair_windows", sql("SELECT time, symbol, exchange FROM (SELECT time_bucket(INTERVAL '5 minutes', t.time) AS time, symbol, exchange FROM trades t EXCEPT SELECT time_bucket(INTERVAL '5 minutes', t.time), symbol, exchange FROM trades t WHERE side = 'buy') ORDER BY 1 DESC, 2, 3 LIMIT 500", "trades"))
def repair_windows(m: Market):
    """J7 where candles are missing: bars whose candles saw the buys only."""
    bars = B.bars_5m(B.candles(m.trades.filter("side = 'buy'"), "5 minutes"), B.minute_trades(m.trades), B.minute_books(m.books), B.minute_context(m.context), as_of())
    return S.repair_times(m.trades.select(bucket("time", "5 minutes").alias("time"), "symbol", "exchange"), bars, 500)


_MISSING = f"""SELECT symbol, min(time) AS earliest_missing, max(time) AS latest_missing, count(*) AS missing FROM (SELECT s.symbol, g.time FROM (SELECT DISTINCT symbol FROM trades) s CROSS JOIN (SELECT unnest(generate_series({T0}, {T} - INTERVAL 30 MINUTE, INTERVAL 30 MINUTE)) AS time) g EXCEPT SELECT symbol, time_bucket(INTERVAL '30 minutes', t.time) FROM trades t) GROUP BY symbol"""


@query("gap_candidates", sql("SELECT symbol, earliest_missing AS gap_start, latest_missing + INTERVAL 29 MINUTE AS gap_end, missing FROM mi", "trades", extra={"mi": _MISSING}))
def gap_candidates(m: Market):
    return S.gap_candidates(S.missing_buckets(m.trades, start(), as_of(), 30))


@query("backfill_ranges", sql(f"""SELECT * FROM (SELECT exchange, symbol, channel, earliest_raw_time, latest_raw_time, row_count, CASE WHEN latest_raw_time < {T} - INTERVAL 60 MINUTE THEN 'tail' WHEN earliest_raw_time > {T0} + INTERVAL 60 MINUTE THEN 'head' END AS part,
    CASE WHEN latest_raw_time < {T} - INTERVAL 60 MINUTE THEN greatest(latest_raw_time, {T0}) WHEN earliest_raw_time > {T0} + INTERVAL 60 MINUTE THEN {T0} END AS range_start, CASE WHEN latest_raw_time < {T} - INTERVAL 60 MINUTE THEN {T} WHEN earliest_raw_time > {T0} + INTERVAL 60 MINUTE THEN least(earliest_raw_time, {T}) END AS range_end FROM sync) WHERE part IS NOT NULL""", "sync"))
def backfill_ranges(m: Market):
    return S.backfill_ranges(m.sync, start(), as_of())


@query("time_windows", sql("SELECT exchange, symbol, window_start, least(window_start + INTERVAL 1440 MINUTE, hi) AS window_end, CAST(ceil((epoch(hi) - epoch(lo)) / 86400) - floor((epoch(window_start) - epoch(lo)) / 86400) AS BIGINT) AS window_no FROM (SELECT *, unnest(generate_series(lo, hi, INTERVAL 1440 MINUTE)) AS window_start FROM (SELECT exchange, symbol, date_trunc('second', min(time)) AS lo, date_trunc('second', max(time)) AS hi FROM trades GROUP BY 1, 2) WHERE lo < hi) WHERE window_start < hi", "trades"))
def time_windows(m: Market):
    spans = m.trades.groupBy("exchange", "symbol").agg(F.date_trunc("second", F.min("time")).alias("lo"), F.date_trunc("second", F.max("time")).alias("hi"))
    return S.time_windows(spans, "lo", "hi", 1440).select("exchange", "symbol", "window_start", "window_end", "window_no")


@query("stale_streams", sql("SELECT symbol, last_trade, time_bucket(INTERVAL '60 minutes', last_trade) AS expected_bar, last_bar, last_bar IS NULL OR last_bar + INTERVAL 60 MINUTE < time_bucket(INTERVAL '60 minutes', last_trade) AS stale FROM (SELECT symbol, max(time) AS last_trade FROM trades GROUP BY 1) LEFT JOIN (SELECT symbol, max(time) AS last_bar FROM c5 GROUP BY 1) USING (symbol)", "c5"))
def stale_streams(m: Market):
    return S.stale_streams(m.trades, m.candles_5m, 60, 60)


@query("panel_fallback", sql("SELECT symbol, CASE WHEN coalesce(a.n, 0) / 720 >= 0.4 THEN 'primary' WHEN coalesce(b.n, 0) / 720 >= 0.4 THEN 'fallback' END AS source FROM (SELECT DISTINCT symbol FROM trades) LEFT JOIN (SELECT symbol, count(DISTINCT time) AS n FROM c1h WHERE exchange = 'ex0' GROUP BY 1) a USING (symbol) LEFT JOIN (SELECT symbol, count(DISTINCT time) AS n FROM c1h GROUP BY 1) b USING (symbol)", "c1h"))
def panel_fallback(m: Market):
    wanted = m.trades.select("symbol").distinct()
    return S.choose_source(wanted, [("primary", m.candles_1h.filter("exchange = 'ex0'")), ("fallback", m.candles_1h)], 720, 0.4)


_STATE = "SELECT symbol, exchange, {t} AS time, sum(size) AS volume, count(*) AS n, max(price) AS high, min(price) AS low FROM trades WHERE CAST(trade_id AS BIGINT) {w} GROUP BY symbol, exchange"


@query("merge_additive", sql(f"SELECT symbol, exchange, {rr('coalesce(a.volume, 0) + coalesce(b.volume, 0) AS volume')}, coalesce(a.n, 0) + coalesce(b.n, 0) AS n, {rr('greatest(a.high, b.high) AS high', 'least(a.low, b.low) AS low')} FROM a FULL JOIN b USING (symbol, exchange)", "trades", extra={"a": _STATE.format(t="max(time)", w="% 5 = 0"), "b": _STATE.format(t="max(time)", w="% 5 <> 0")}))
def merge_additive(m: Market):
    part = lambda test: m.trades.filter(test).groupBy("symbol", "exchange").agg(F.sum("size").alias("volume"), F.count("*").alias("n"), F.max("price").alias("high"), F.min("price").alias("low"))
    i = F.col("trade_id").cast("long")
    return rounded(S.merge(part(i % 5 == 0), part(i % 5 != 0), ["symbol", "exchange"], {"volume": "add", "n": "add", "high": "greatest", "low": "least"}))


@query("merge_latest", sql(f"SELECT symbol, exchange, CASE WHEN b.time IS NOT NULL AND (a.time IS NULL OR b.time >= a.time) THEN b.time ELSE a.time END AS time, {rr('CASE WHEN b.time IS NOT NULL AND (a.time IS NULL OR b.time >= a.time) THEN b.price ELSE a.price END AS price')} FROM a FULL JOIN b USING (symbol, exchange)", "trades", extra={k: f"SELECT symbol, exchange, max(t.time) AS time, arg_max(price, t.time) AS price FROM trades t WHERE CAST(trade_id AS BIGINT) % 2 = {v} GROUP BY 1, 2" for k, v in (("a", 0), ("b", 1))}))
def merge_latest(m: Market):
    part = lambda v: m.trades.filter(F.col("trade_id").cast("long") % 2 == v).groupBy("symbol", "exchange").agg(F.max("time").alias("time"), F.max_by("price", "time").alias("price"))
    return rounded(S.merge(part(0), part(1), ["symbol", "exchange"], {"time": "latest", "price": "latest"}, time="time"))


@query("insert_ignore", sql("SELECT symbol, exchange, trade_id FROM trades WHERE CAST(trade_id AS BIGINT) % 3 <> 0", "trades"))
def insert_ignore(m: Market):
    base = m.trades.filter(F.col("trade_id").cast("long") % 3 == 0)
    return S.insert_ignore(base, m.trades.union(m.trades), ["symbol", "exchange", "trade_id"]).select("symbol", "exchange", "trade_id")


@query("finalize_due", sql("SELECT exchange, count(*) AS finalized_rows, min(time) AS window_start, max(time) AS window_end FROM b5 WHERE finalization_due_at > TIMESTAMP '2024-01-20' AND finalization_due_at <= TIMESTAMP '2024-01-25' GROUP BY exchange", "b5"))
def finalize_due(m: Market):
    early = B.finality(m.bars_5m.drop("is_provisional", "is_finalized", "finalization_due_at", "finalized_at"), F.lit("2024-01-20").cast("timestamp"), "5 MINUTES", 3)
    return S.finalise_report(S.finalise_due(early, F.lit("2024-01-25").cast("timestamp")))


# ---- health ----------------------------------------------------------------------------------------

_HEALTH_AT = "2024-01-30 23:00:00"
_HT = f"TIMESTAMP '{_HEALTH_AT}'"
_CH = H.CHANNELS
_HEALTH = {
    "piv": f"SELECT exchange, symbol, {', '.join(f'''max(latest_raw_time) FILTER (WHERE channel = '{c}') AS {c}_latest_raw_time, CAST(coalesce(sum(row_count) FILTER (WHERE channel = '{c}'), 0) AS BIGINT) AS {c}_row_count''' for c in _CH)}, min(earliest_raw_time) FILTER (WHERE channel = 'candle_5m') AS e0 FROM sync GROUP BY 1, 2",
    "rc": f"SELECT exchange, symbol, {', '.join(f'count(*) FILTER (WHERE time >= {_HT} - INTERVAL 24 HOUR AND {t}) AS recent_{n}_24h' for n, t in (('feature_rows', 'TRUE'), ('candle_observed_rows', 'candle_observed'), ('trade_observed_rows', 'trade_observed'), ('orderbook_observed_rows', 'orderbook_observed'), ('execution_observed_rows', '(orderbook_observed AND coalesce(spread, 0) > 0 AND (bid_depth_10 > 0 OR ask_depth_10 > 0))'), ('finalized_rows', 'is_finalized')))}, max(time) AS latest_feature_time, max(time) FILTER (WHERE is_finalized) AS finalized_through FROM b5 GROUP BY 1, 2",
    "h0": f"SELECT *, CASE WHEN candle_5m_latest_raw_time IS NULL THEN 0 ELSE greatest(CAST((epoch(time_bucket(INTERVAL '5 minutes', candle_5m_latest_raw_time)) - greatest(epoch(time_bucket(INTERVAL '5 minutes', e0)), epoch(time_bucket(INTERVAL '5 minutes', {_HT} - INTERVAL 24 HOUR)))) / 300 AS BIGINT) + 1, 0) END AS expected_bars, greatest({', '.join(f'{c}_latest_raw_time' for c in _CH)}) AS latest_any_raw_time FROM piv JOIN rc USING (exchange, symbol)",
    "h": f"""SELECT *, coalesce(latest_any_raw_time >= {_HT} - INTERVAL 6 HOUR, FALSE) AS active_recent, {', '.join(f'CASE WHEN expected_bars <= 0 THEN 0.0 ELSE least({a} / expected_bars, 1.0) END AS {b}' for a, b in (('recent_feature_rows_24h', 'coverage_ratio'), ('recent_finalized_rows_24h', 'finalized_ratio')))},
        {', '.join(f"CAST(greatest(floor(epoch({_HT})) - floor(epoch({c}_latest_raw_time)), 0) AS BIGINT) AS {c}_raw_lag_seconds" for c in _CH)}, CAST(greatest(epoch({_HT}) - epoch(latest_feature_time), 0) AS BIGINT) AS feature_lag_seconds, greatest(epoch({_HT}) - epoch(finalized_through), 0) / 60.0 AS finalized_lag_minutes,
        {', '.join(f'CASE WHEN recent_feature_rows_24h = 0 THEN 0.0 ELSE recent_{n}_rows_24h / recent_feature_rows_24h END AS recent_{n}_share_24h' for n in ('candle_observed', 'trade_observed', 'orderbook_observed', 'execution_observed', 'finalized'))} FROM h0""",
}
_HCOLS = ["exchange", "symbol", "expected_bars", "active_recent", "latest_any_raw_time", "latest_feature_time", "finalized_through", "feature_lag_seconds", *[f"{c}_raw_lag_seconds" for c in _CH], *[f"{c}_row_count" for c in _CH], "recent_feature_rows_24h", "recent_finalized_rows_24h", "recent_execution_observed_rows_24h"]
_HNUM = ["coverage_ratio", "finalized_ratio", "finalized_lag_minutes", "recent_candle_observed_share_24h", "recent_trade_observed_share_24h", "recent_orderbook_observed_share_24h", "recent_execution_observed_share_24h", "recent_finalized_share_24h"]


def _symbols(m: Market):
    # Both are read several times; the bars and the bounds are computed once.
    return H.symbol_health(stored(m.sync, "sync"), stored(m.bars_5m, "bars"), F.lit(_HEALTH_AT).cast("timestamp"))


@query("health_symbol", sql(f"SELECT {', '.join(_HCOLS)}, {rr(*_HNUM)} FROM h", "sync", "b5", extra=_HEALTH))
def health_symbol(m: Market):
    return rounded(_symbols(m).select(*_HCOLS, *_HNUM))


@query("health_exchange", sql(f"""SELECT exchange, count(*) AS tracked_symbols, count(*) FILTER (WHERE active_recent) AS active_symbols, count(*) FILTER (WHERE NOT active_recent) AS inactive_symbols, count(*) FILTER (WHERE active_recent AND candle_5m_latest_raw_time IS NULL) AS active_symbols_missing_candle_5m, count(*) FILTER (WHERE active_recent AND recent_feature_rows_24h = 0) AS active_symbols_without_recent_features,
    max(candle_5m_raw_lag_seconds) FILTER (WHERE active_recent) AS max_candle_5m_raw_lag_seconds, max(feature_lag_seconds) FILTER (WHERE active_recent) AS max_feature_lag_seconds, {rr('avg(coverage_ratio) FILTER (WHERE active_recent) AS avg_coverage_ratio', 'avg(finalized_ratio) FILTER (WHERE active_recent) AS avg_finalized_ratio')}, max(latest_any_raw_time) FILTER (WHERE active_recent) AS latest_any_raw_time FROM h GROUP BY exchange""", "sync", "b5", extra=_HEALTH))
def health_exchange(m: Market):
    return rounded(H.exchange_health(_symbols(m)))


_TH = H.Thresholds(candle_lag=1800, raw_stale=3600, feature_lag=1800, coverage=0.9, finalized=0.9, finalized_lag_minutes=60, execution_observed=0.5)
_LATE = lambda c: f"coalesce({c}_raw_lag_seconds > {_TH.lag(c)}, FALSE)"
_LIVE = f"coalesce(orderbook_l2_raw_lag_seconds <= {_TH.raw_stale}, FALSE)"
_EVAL = {
    **_HEALTH,
    "e1": f"SELECT *, {_LIVE} AS live, active_recent AND {_LIVE} AND recent_trade_observed_share_24h >= {_TH.trade_observed_for_eligibility} AS readiness_eligible FROM h",
    "e2": f"SELECT *, CASE WHEN NOT active_recent THEN 'INACTIVE' WHEN NOT live OR {_LATE('orderbook_l2')} OR {_LATE('funding')} OR {_LATE('open_interest')} THEN 'LOCAL_STALE' WHEN {_LATE('trade')} OR {_LATE('candle_5m')} OR NOT readiness_eligible THEN 'LIVE_SPARSE' ELSE 'HEALTHY' END AS liveness_class FROM e1",
    "e3": f"""SELECT *, CASE WHEN NOT active_recent THEN 'INACTIVE' WHEN NOT readiness_eligible AND live THEN 'IDLE_LIVE'
        WHEN NOT live OR candle_5m_latest_raw_time IS NULL OR (liveness_class <> 'LIVE_SPARSE' AND {_LATE('candle_5m')}) OR latest_feature_time IS NULL OR coalesce(feature_lag_seconds > {_TH.feature_lag}, TRUE) OR recent_feature_rows_24h = 0 THEN 'CRITICAL'
        WHEN orderbook_l2_latest_raw_time IS NULL OR funding_latest_raw_time IS NULL OR {_LATE('orderbook_l2')} OR {_LATE('funding')} OR (liveness_class <> 'LIVE_SPARSE' AND (trade_latest_raw_time IS NULL OR {_LATE('trade')})) OR liveness_class = 'LIVE_SPARSE'
          OR coverage_ratio < {_TH.coverage} OR finalized_ratio < {_TH.finalized} OR coalesce(finalized_lag_minutes > {_TH.finalized_lag_minutes}, TRUE) OR recent_execution_observed_share_24h < {_TH.execution_observed} THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM e2""",
}


@query("health_status", sql("SELECT exchange, symbol, status, liveness_class, readiness_eligible FROM e3", "sync", "b5", extra=_EVAL))
def health_status(m: Market):
    return H.evaluate(_symbols(m), _TH).select("exchange", "symbol", "status", "liveness_class", "readiness_eligible")


@query("health_summary", sql(f"SELECT count(*) AS symbols, {', '.join(f'''count(*) FILTER (WHERE status = '{s}') AS {s.lower()}_symbols''' for s in H.ISSUE_RANK)}, count(*) FILTER (WHERE readiness_eligible) AS eligible_symbols, {rr('avg(coverage_ratio) AS avg_coverage_ratio', 'avg(finalized_ratio) AS avg_finalized_ratio')}, max(feature_lag_seconds) AS max_feature_lag_seconds FROM e3", "sync", "b5", extra=_EVAL))
def health_summary(m: Market):
    return rounded(H.summary(H.evaluate(_symbols(m), _TH)).drop("critical_sample"))


@query("venue_sanity", sql("SELECT symbol, CASE WHEN here AND listed THEN 'MATCHED' WHEN listed THEN 'LOCAL_MISSING' WHEN here THEN 'EXTERNAL_MISSING' ELSE 'INACTIVE' END AS presence FROM (SELECT symbol, coalesce(a.here, FALSE) AS here, coalesce(b.listed, FALSE) AS listed FROM (SELECT symbol, TRUE AS here FROM trades WHERE exchange = 'ex0' AND time >= TIMESTAMP '2024-01-30 12:00:00' GROUP BY symbol) a FULL JOIN (SELECT symbol, TRUE AS listed FROM trades WHERE exchange = 'ex1' AND time >= TIMESTAMP '2024-01-30 12:00:00' GROUP BY symbol) b USING (symbol))", "trades"))
def venue_sanity(m: Market):
    new = m.trades.filter(F.col("time") >= F.lit("2024-01-30 12:00:00").cast("timestamp"))
    at = lambda e, n: new.filter(F.col("exchange") == e).groupBy("symbol").agg(F.lit(True).alias(n))
    return H.venue_sanity(at("ex0", "active_recent"), at("ex1", "active"))


# ---- joins and grid --------------------------------------------------------------------------------


@query("asof_funding", sql(f"SELECT b.time, b.symbol, b.exchange, {rr('b.close AS close', 'f.funding_rate AS funding_rate')} FROM c1h b ASOF LEFT JOIN context f ON b.symbol = f.symbol AND b.exchange = f.exchange AND b.time >= f.time", "c1h", "context"))
def asof_funding(m: Market):
    return rounded(X.as_of_join(m.candles_1h.select("time", "symbol", "exchange", "close"), m.context, ["symbol", "exchange"], "funding_rate"))


@query("panel_grid", sql(f"SELECT time, symbol, {rr('close', 'funding_rate')} FROM grid", "grid"))
def panel_grid(m: Market):
    return rounded(m.grid.select("time", "symbol", "close", "funding_rate"))


@query("price_vs_sentiment", sql(f"SELECT ts, symbol, {rr('price', 'coalesce(s.sentiment, 0) AS sentiment')} FROM (SELECT time_bucket(INTERVAL '1 hour', t.time) AS ts, symbol, avg(price) AS price FROM trades t GROUP BY 1, 2) p LEFT JOIN (SELECT time_bucket(INTERVAL '1 hour', observed_at) AS ts, symbol, avg(sentiment_score) AS sentiment FROM sentiment GROUP BY 1, 2) s USING (ts, symbol)", "trades", "sentiment"))
def price_vs_sentiment(m: Market):
    p = B.bucket_series(m.trades, "time", "1 hour", ["symbol"], price=F.avg("price")).withColumnRenamed("bucket", "ts")
    s = B.bucket_series(m.sentiment, "observed_at", "1 hour", ["symbol"], sentiment=F.avg("sentiment_score")).withColumnRenamed("bucket", "ts")
    return rounded(p.join(s, ["ts", "symbol"], "left").fillna(0.0, ["sentiment"]))
