"""Registered queries on universes, repair predicates, daily statistics, attribution, scales and micro-structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import health as H
from strandline.operators import perf as P
from strandline.operators import research as R
from strandline.operators import universe as U
from strandline.plans.common import Market, query, rounded, rr, sql
from strandline.plans.market import _HEALTH, _HT, _HEALTH_AT
from strandline.plans.research import _RAW, _W, _betas, _rk, _signals


@query("universe", "SELECT DISTINCT upper(trim(p_brand)) AS symbol FROM part WHERE p_size % 7 <> 0 AND upper(trim(p_brand)) NOT IN (SELECT upper(min(p_brand)) FROM part)")
def universe(m: Market):
    p = m.table("part")
    worst = p.agg(F.upper(F.min("p_brand")).alias("symbol"))
    return U.universe(p.select(F.col("p_brand").alias("symbol"), (F.col("p_size") % 7 == 0).alias("delisted"))).join(worst, "symbol", "left_anti")


@query("choose_params", "SELECT o_orderpriority AS strategy_name, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def choose_params(m: Market):
    return U.choose(m.runs, strategy_name="all", symbol="F").groupBy("strategy_name").agg(F.count("*").alias("n"))


@query("public_rows", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer) AND c_acctbal >= 0 AND c_nationkey % 2 = 1")
def public_rows(m: Market):
    c = m.table("customer")
    least = c.agg(F.min("c_mktsegment").alias("c_mktsegment"))
    rows = c.join(least, "c_mktsegment").withColumns({"deleted_at": F.when(F.col("c_acctbal") < 0, F.lit("t")), "is_archived": F.col("c_nationkey") % 2 == 0})
    return U.public_rows(rows, ["c_custkey", "c_name"], F.lit(True), "deleted_at", "is_archived")


@query("list_counts", "SELECT c_nationkey, count(*) AS card_count FROM customer WHERE c_acctbal >= 0 GROUP BY 1")
def list_counts(m: Market):
    return U.list_counts(m.table("customer").withColumn("archived", F.col("c_acctbal") < 0), "c_nationkey", "archived")


@query("ordered_merge", "SELECT k AS symbol, row_number() OVER (ORDER BY p, o, k) AS position FROM (SELECT k, min(p) AS p, arg_min(o, p) AS o FROM (SELECT c_name AS k, 0 AS p, c_custkey AS o FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT c_name, 1, c_custkey FROM customer) GROUP BY k)")
def ordered_merge(m: Market):
    c = m.table("customer").select(F.col("c_name").alias("symbol"), "c_custkey")
    return U.ordered_merge(c.filter("c_custkey % 9 = 0"), c, "symbol", "c_custkey")


@query("repair_candidates", sql(f"SELECT exchange, symbol, coalesce(act >= {_HT} - INTERVAL 6 HOUR, FALSE) AND CASE WHEN candle_5m_latest_raw_time IS NULL THEN coalesce(trade_latest_raw_time >= {_HT} - INTERVAL 6 HOUR, FALSE) ELSE candle_5m_latest_raw_time < date_trunc('minute', act) OR candle_5m_latest_raw_time < {_HT} - INTERVAL 30 MINUTE END AS repair FROM (SELECT *, greatest(trade_latest_raw_time, orderbook_l2_latest_raw_time, funding_latest_raw_time, open_interest_latest_raw_time) AS act FROM piv)", "sync", extra={"piv": _HEALTH["piv"]}))
def repair_candidates(m: Market):
    at = F.lit(_HEALTH_AT).cast("timestamp")
    return U.needs_repair(H.channel_pivot(m.sync), at - F.expr("INTERVAL 6 HOURS"), at - F.expr("INTERVAL 30 MINUTES")).select("exchange", "symbol", "repair")


@query("repair_order", sql("SELECT exchange, symbol, row_number() OVER (PARTITION BY exchange ORDER BY candle_5m_latest_raw_time ASC NULLS FIRST, greatest(trade_latest_raw_time, orderbook_l2_latest_raw_time, funding_latest_raw_time) DESC NULLS LAST, symbol) AS place FROM piv", "sync", extra={"piv": _HEALTH["piv"]}))
def repair_order(m: Market):
    from pyspark.sql import Window

    p = H.channel_pivot(m.sync)
    return p.select("exchange", "symbol", F.row_number().over(Window.partitionBy("exchange").orderBy(*U.repair_order(p))).alias("place"))


_DAILY = f"SELECT date_trunc('day', time) AS day, symbol, avg(x) AS avg_ret, stddev_samp(x) AS vol, (max(close) - min(close)) / nullif(min(close), 0) AS intraday_range FROM (SELECT *, CASE WHEN lag(close) OVER ({_W}) IS NULL OR lag(close) OVER ({_W}) = 0 THEN 0 ELSE (close - lag(close) OVER ({_W})) / lag(close) OVER ({_W}) END AS x FROM db) GROUP BY 1, 2"


@query("daily_market", sql(f"SELECT day, symbol, {rr('avg_ret', 'vol', 'intraday_range')} FROM dm", "db", extra={"dm": _DAILY}))
def daily_market(m: Market):
    return rounded(U.daily_market(m.daily_bars))


@query("quality_report", sql(f"SELECT symbol, bars, last_bar, last_book, {rr('invalid_ohlc_ratio', 'avg_spread_pct')} FROM (SELECT symbol, count(*) AS bars, max(time) AS last_bar, avg(CASE WHEN high < low THEN 1.0 ELSE 0.0 END) AS invalid_ohlc_ratio FROM c1h GROUP BY 1) LEFT JOIN (SELECT symbol, avg(spread_pct) AS avg_spread_pct, max(time) AS last_book FROM books GROUP BY 1) USING (symbol)", "c1h", "books"))
def quality_report(m: Market):
    return rounded(U.quality_report(m.candles_1h, m.books))


#: Runs moved into the weeks that the market data cover, by key.
_RUNS_AT = "TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CAST(run_id % 30 AS INTEGER)"
_MERGED = {
    "dm": _DAILY,
    "mk": "SELECT day, avg(avg_ret) AS mkt_ret, avg(vol) AS mkt_vol, avg(intraday_range) AS mkt_range FROM dm GROUP BY 1",
    "ss": "SELECT date_trunc('day', observed_at) AS day, avg(sentiment_score) AS sent, avg(confidence) AS sent_conf, CAST(count(*) AS DOUBLE) AS sent_n FROM sentiment GROUP BY 1",
    "jm": f"SELECT run_id, net_return_pct, {', '.join(f'coalesce({c}, 0.0) AS {c}' for c in ('mkt_ret', 'mkt_vol', 'mkt_range', 'sent', 'sent_conf', 'sent_n'))} FROM (SELECT *, {_RUNS_AT} AS day FROM runs) LEFT JOIN mk USING (day) LEFT JOIN ss USING (day)",
}
_FACTORS = ["mkt_ret", "mkt_vol", "mkt_range", "sent", "sent_conf", "sent_n"]


def _merged(m: Market):
    runs = m.runs.withColumn("run_at", F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=(F.col("run_id") % 30).cast("int")))
    return U.daily_merge(runs, U.daily_market(m.daily_bars), m.sentiment)


@query("daily_merge", sql(f"SELECT run_id, {rr(*_FACTORS)} FROM jm", "db", "sentiment", "runs", extra=_MERGED))
def daily_merge(m: Market):
    return rounded(_merged(m).select("run_id", *_FACTORS))


@query("attribution_gram", sql("SELECT " + rr(*[f"sum({a} * {b}) AS {a}__{b}" for i, a in enumerate(_FACTORS) for b in _FACTORS[i:]], digits=3) + " FROM jm", "db", "sentiment", "runs", extra=_MERGED))
def attribution_gram(m: Market):
    g = R.gram(_merged(m).withColumn("family", F.lit(1)), ["family"], _FACTORS, "net_return_pct")
    return rounded(g.select(*[f"{a}__{b}" for i, a in enumerate(_FACTORS) for b in _FACTORS[i:]]), 3)


@query("attribution")
def attribution(m: Market):
    """The least-squares solve on the sums above; the tests compare such a fit with numpy."""
    g = R.gram(_merged(m).withColumn("family", F.lit(1)), ["family"], _FACTORS, "net_return_pct")
    return R.ridge(g, ["family"], _FACTORS, "net_return_pct", penalty=0.0)


_SC = {**_RAW, "rg": f"SELECT time, greatest(least(b, 1), -1) AS breadth, greatest(least(a, 1), -1) AS anchor_trend, greatest(least((km + ks + b + a) / 4, 1), -1) AS score FROM (SELECT time, avg((km + ks) / 2) AS b, coalesce(avg((km + ks) / 2) FILTER (WHERE symbol IN ('click', 'view')), 0) AS a, avg(km) AS km, avg(ks) AS ks FROM (SELECT *, {_rk('medium_return')} AS km, {_rk('slow_return')} AS ks FROM sig) GROUP BY time)"}


@query("gross_net_targets", sql(f"SELECT time, {rr('gross AS gross_target', 'gross * greatest(least(score, 1), -1) * CASE WHEN abs(score) < 0.15 THEN 0 ELSE least((abs(score) - 0.15) / 0.85, 1) END * 0.5 AS net_target', digits=7)} FROM (SELECT *, 0.5 * CASE WHEN abs(anchor_trend) < 0.15 AND abs(breadth) < 0.15 THEN 0.5 ELSE 1.0 END * greatest(0.4, 1 - greatest(1 - abs(anchor_trend) / 0.15, 0) * 0.6) AS gross FROM rg)", "gr", extra=_SC))
def gross_net_targets(m: Market):
    return rounded(R.gross_net_targets(R.regimes(_signals(m), ("click", "view"))).select("time", "gross_target", "net_target"), 7)


@query("compression_penalty")
def compression_penalty(m: Market):
    """Robust z of each symbol's residual size and the gross scale that it gives; the tests check the parts."""
    z = R.robust_z(_betas(m).filter("residual IS NOT NULL").withColumn("size", F.abs("residual")), "size", ["symbol"], "time")
    return z.select("time", "symbol", "z", R.compression_scale(F.coalesce("z", F.lit(0.0))).alias("scale"))


@query("micro_score", sql(f"""SELECT time, symbol, exchange, {rr('imbalance', 'CASE WHEN c = 24 AND sd > 1e-12 THEN (micro_raw - mu) / sd ELSE 0 END AS micro_z', 'v AS vol')} FROM (SELECT *, count(micro_raw) OVER k AS c, stddev_samp(micro_raw) OVER k AS sd, avg(micro_raw) OVER k AS mu, coalesce(stddev_samp(ret) OVER k, 0) AS v FROM (SELECT *, 0.65 * imbalance + 0.35 * ret * ln(1 + greatest(volume, 0)) AS micro_raw FROM
    (SELECT *, coalesce(close / nullif(lag(close) OVER (PARTITION BY symbol, exchange ORDER BY time), 0) - 1, 0) AS ret, coalesce((bid_depth_10 - ask_depth_10) / nullif(bid_depth_10 + ask_depth_10, 0), 0) AS imbalance FROM b5)) WINDOW k AS (PARTITION BY symbol, exchange ORDER BY time ROWS 23 PRECEDING))""", "b5"))
def micro_score(m: Market):
    return rounded(P.micro_features(m.bars_5m).select("time", "symbol", "exchange", "imbalance", "micro_z", "vol"))


@query("micro_backtest")
def micro_backtest(m: Market):
    """Hashed lags and fills, so there is no SQL form; the tests check bounds and repetition."""
    return P.micro_execution(P.micro_features(m.bars_5m)).select("time", "symbol", "exchange", "position", "turnover", "filled", "strategy_ret", "equity")


@query("regime_buckets", sql("SELECT symbol, CASE WHEN beta - 1 <= -0.15 THEN 'down' WHEN beta - 1 >= 0.15 THEN 'up' ELSE 'flat' END AS bucket, count(*) AS bars FROM be WHERE beta IS NOT NULL GROUP BY 1, 2", "gr", extra={"mk": "SELECT time, avg(r) AS market FROM gr GROUP BY time", "bj": "SELECT * FROM gr JOIN mk USING (time)", "be": f"SELECT symbol, CASE WHEN count(CASE WHEN r IS NOT NULL AND market IS NOT NULL THEN 1 END) OVER w = 12 THEN CASE WHEN var_pop(market) OVER w <= 1e-10 THEN 0.0 ELSE least(greatest(covar_pop(r, market) OVER w / var_pop(market) OVER w, -3), 3) END END AS beta FROM bj WINDOW w AS ({_W} ROWS 11 PRECEDING)"}))
def regime_buckets(m: Market):
    return _betas(m).filter("beta IS NOT NULL").groupBy("symbol", P.directional_bucket(F.col("beta") - 1).alias("bucket")).agg(F.count("*").alias("bars"))
