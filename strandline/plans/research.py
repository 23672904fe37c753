"""Registered queries on ordered features, cross-sections, performance, costs and risk."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import columns as K
from strandline.operators import costs as C
from strandline.operators import features as X
from strandline.operators import perf as P
from strandline.operators import research as R
from strandline.plans.common import Market, query, r, rounded, rr, sql
from strandline.sources.scratch import stored

_W = "PARTITION BY symbol ORDER BY time"


def _gate(expr: str, value: str, n: int) -> str:
    """DuckDB: an aggregate over the last n rows, null unless all hold the value."""
    w = f"OVER ({_W} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({value}) {w} = {n} THEN {expr} {w} END"


def _vol(n: int, rname: str = "r") -> str:
    return f"sqrt(greatest({_gate(f'avg({rname} * {rname})', rname, n)}, 1e-8) + CASE WHEN count({rname}) OVER ({_W} ROWS {n - 1} PRECEDING) = {n} THEN 0 END)"


def _floor(v: str) -> str:
    """DuckDB: at least 1e-4; null stays null."""
    return f"(CASE WHEN {v} IS NOT NULL THEN greatest({v}, 1e-4) END)"


def _lagw(c: str, n: int) -> str:
    return f"lag({c}, {n}) OVER ({_W})"


def _chg(n: int, c: str = "close") -> str:
    return f"CASE WHEN {c} > 0 AND {_lagw(c, n)} > 0 THEN ln({c} / {_lagw(c, n)}) END"


def _scaled(n: int) -> str:
    return f"({_chg(n)}) / {_floor(_vol(max(n // 2, 3)))}"


def _ema_dist(n: int, vol: str) -> str:
    ema = " + ".join(f"{w!r} * {_lagw('close', n - 1 - k) if k < n - 1 else 'close'}" for k, w in enumerate(X.ema_weights(n)))
    return f"CASE WHEN count(close) OVER ({_W} ROWS {n - 1} PRECEDING) = {n} THEN ln(nullif(close / nullif({ema}, 0), 0)) END / {_floor(vol)}"


def _tstat(n: int) -> str:
    w = f"OVER ({_W} ROWS {n - 1} PRECEDING)"
    sxx = n * (n * n - 1) / 12.0
    slope = f"(covar_pop(i, y) {w} * {n} / {sxx})"
    return f"CASE WHEN count(y) {w} = {n} THEN {slope} / sqrt(greatest(greatest(var_pop(y) {w} * {n} - {slope} * covar_pop(i, y) {w} * {n}, 0.0) / {max(n - 2, 1)} / {sxx}, 1e-12)) END"


_MOVES = {
    "gi": f"SELECT *, CASE WHEN close > 0 THEN ln(close) END AS y, CAST(row_number() OVER ({_W}) AS DOUBLE) AS i, high - lag(high) OVER ({_W}) AS um, lag(low) OVER ({_W}) - low AS dm, lag(close) OVER ({_W}) AS pc FROM gr",
    "gm": "SELECT *, CASE WHEN um IS NULL THEN NULL WHEN um > dm AND um > 0 THEN um ELSE 0.0 END AS up, CASE WHEN dm IS NULL THEN NULL WHEN dm > um AND dm > 0 THEN dm ELSE 0.0 END AS down, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM gi",
}


def _adx(n: int) -> str:
    tr = f"greatest({_gate('avg(tr)', 'tr', n)}, 1e-9)"
    plus, minus = f"(100.0 * {_gate('avg(up)', 'tr', n)} / {tr})".replace("CASE", "(CASE").replace("END", "END)"), f"(100.0 * {_gate('avg(down)', 'tr', n)} / {tr})".replace("CASE", "(CASE").replace("END", "END)")
    return f"100.0 * abs({plus} - {minus}) / greatest({plus} + {minus}, 1e-9) + CASE WHEN count(tr) OVER ({_W} ROWS {n - 1} PRECEDING) = {n} THEN 0 END"


def _feature(name: str, column, oracle: str, extra: dict | None = None, prepare=lambda df: df) -> None:
    """One windowed feature on the panel grid."""

    @query(name, sql(f"SELECT time, symbol, {rr(f'{oracle} AS value')} FROM {list(extra)[-1] if extra else 'gr'}", "gr", extra=extra))
    def run(m: Market):
        return prepare(X.with_returns(m.grid)).withColumn("value", column()).select("time", "symbol", r("value").alias("value"))


_feature("roll_vol", lambda: X.rolling_volatility(6), _vol(6))
_feature("scaled_return", lambda: X.scaled_return(6), _scaled(6))
_feature("sma_spread", lambda: X.sma_spread(3, 12), f"({_gate('avg(close)', 'close', 3)}) / ({_gate('avg(close)', 'close', 12)}) - 1")
_feature("tstat", lambda: X.t_statistic(8), _tstat(8), _MOVES)
_feature("adx", lambda: X.directional_index(6), _adx(6), _MOVES, X.with_directional_moves)
_feature("perturbation", lambda: X.perturbation(2, X.rolling_volatility(6)), f"({_chg(2)}) / {_floor(_vol(6))}")
_feature("ema_distance", lambda: X.ema_distance(5, X.rolling_volatility(6)), _ema_dist(5, _vol(6)))
_feature("oi_momentum", lambda: X.interest_momentum(6), _chg(6, "open_interest"))
_feature("persistence", lambda: X.directional_persistence(6), f"100.0 * abs(({_gate('avg(greatest(r, 0.0))', 'r', 6)}) - ({_gate('avg(greatest(-r, 0.0))', 'r', 6)})) / greatest(({_gate('avg(greatest(r, 0.0))', 'r', 6)}) + ({_gate('avg(greatest(-r, 0.0))', 'r', 6)}), 1e-9) + CASE WHEN count(r) OVER ({_W} ROWS 5 PRECEDING) = 6 THEN 0 END")
_feature("summed_return", lambda: X.summed_return(6), f"({_gate('sum(r)', 'r', 6)}) / {_floor(_vol(3))}")
_feature("rolling_z", lambda: X.rolling_z("close", 10), f"CASE WHEN ({_gate('stddev_samp(close)', 'close', 10)}) > 0 THEN (close - ({_gate('avg(close)', 'close', 10)})) / ({_gate('stddev_samp(close)', 'close', 10)}) END")
_feature("rolling_median", lambda: X.rolling_median("close", 7), _gate("median(close)", "close", 7))
_feature("sma", lambda: X.sma(8), _gate("avg(close)", "close", 8))

_IND = {
    "ii": f"SELECT *, lag(close) OVER ({_W}) AS pc FROM db",
    "im": "SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0.0) END AS gain, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0.0) END AS loss, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS rng FROM ii",
}


def _indicator(name: str, columns, oracles: dict[str, str], prepare=lambda df: df) -> None:
    """Indicators on a symbol's own bars (no grid)."""

    @query(name, sql(f"SELECT time, symbol, {rr(*[f'{q} AS {n}' for n, q in oracles.items()])} FROM im", "db", extra=_IND))
    def run(m: Market):
        return rounded(prepare(m.daily_bars).withColumns(columns()).select("time", "symbol", *oracles))


_indicator("rsi", lambda: {"rsi": X.rsi(7)}, {"rsi": f"CASE WHEN ({_gate('avg(loss)', 'loss', 7)}) = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + ({_gate('avg(gain)', 'gain', 7)}) / ({_gate('avg(loss)', 'loss', 7)})) END"}, X.with_moves)
_indicator("atr", lambda: {"atr": X.atr(7)}, {"atr": _gate("avg(rng)", "rng", 7)}, X.with_moves)
_mid, _sd = f"({_gate('avg(close)', 'close', 10)})", f"({_gate('stddev_pop(close)', 'close', 10)})"
_indicator("bollinger", lambda: X.bollinger(10, 2.0), {"bb_mid": _mid, "bb_upper": f"{_mid} + 2 * {_sd}", "bb_lower": f"{_mid} - 2 * {_sd}", "bb_width": f"4 * {_sd} / {_mid} * 100"})
_indicator("vwap", lambda: {"vwap": X.vwap()}, {"vwap": f"sum((high + low + close) / 3.0 * volume) OVER ({_W} ROWS UNBOUNDED PRECEDING) / sum(volume) OVER ({_W} ROWS UNBOUNDED PRECEDING)"})

_EMA = """RECURSIVE {head}, o AS (SELECT symbol, time, close, row_number() OVER (PARTITION BY symbol ORDER BY time) AS k FROM db),
 e AS (SELECT symbol, time, k, {init} FROM o WHERE k = 1 UNION ALL SELECT o.symbol, o.time, o.k, {step} FROM e JOIN o ON o.symbol = e.symbol AND o.k = e.k + 1)"""


def _recursive(body: str, init: str, step: str) -> str:
    head = sql("", "db").removeprefix("WITH ").strip()
    return "WITH " + _EMA.format(head=head, init=init, step=step) + "\n" + body


_alpha = lambda n: repr(2.0 / (n + 1))


@query("ewm_ema", _recursive(f"SELECT symbol, time, {rr('a AS ema_5', 'b AS ema_21')} FROM e", "close AS a, close AS b", f"{_alpha(5)} * o.close + (1 - {_alpha(5)}) * e.a, {_alpha(21)} * o.close + (1 - {_alpha(21)}) * e.b"))
def ewm_ema(m: Market):
    return rounded(X.ema(m.daily_bars.select("symbol", "time", "close"), {"ema_5": 5, "ema_21": 21}).drop("close"))


@query("macd", _recursive(f"SELECT symbol, time, {rr('a - b AS macd', 's AS macd_signal', 'a - b - s AS macd_histogram')} FROM e", "close AS a, close AS b, 0.0::DOUBLE AS s", f"{_alpha(12)} * o.close + (1 - {_alpha(12)}) * e.a, {_alpha(26)} * o.close + (1 - {_alpha(26)}) * e.b, {_alpha(9)} * ({_alpha(12)} * o.close + (1 - {_alpha(12)}) * e.a - ({_alpha(26)} * o.close + (1 - {_alpha(26)}) * e.b)) + (1 - {_alpha(9)}) * e.s"))
def macd(m: Market):
    return rounded(X.macd(m.daily_bars.select("symbol", "time", "close")).drop("close"))


@query("drawdown", sql(f"SELECT time, symbol, {rr('eq AS equity', 'max(eq) OVER (PARTITION BY symbol ORDER BY time) AS peak', 'eq / max(eq) OVER (PARTITION BY symbol ORDER BY time) - 1 AS drawdown')} FROM (SELECT time, symbol, exp(sum(ln(1 + coalesce(r, 0))) OVER ({_W})) AS eq FROM (SELECT *, close / nullif(lag(close) OVER ({_W}), 0) - 1 AS r FROM db))", "db"))
def drawdown(m: Market):
    w = Window.partitionBy("symbol").orderBy("time")
    return rounded(X.drawdown(m.daily_bars.withColumn("r", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1.0)).select("time", "symbol", "equity", "peak", "drawdown"))


@query("ffill_positions", sql(f"SELECT time, symbol, last_value(d IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS position FROM (SELECT time, symbol, CASE WHEN close > 300 THEN 1 WHEN close < 200 THEN 0 END AS d FROM db)", "db"))
def ffill_positions(m: Market):
    d = m.daily_bars.withColumn("d", F.when(F.col("close") > 300, 1).when(F.col("close") < 200, 0))
    return X.forward_fill(d, "d", "position").select("time", "symbol", "position")


@query("ntile_regimes", sql(f"SELECT vol_q, liq_q, count(*) AS bars, {rr('avg(r) AS mean_r', 'count(*) FILTER (WHERE r > 0) / nullif(count(*) FILTER (WHERE r <> 0), 0) AS hit_rate')} FROM (SELECT r, ntile(4) OVER (PARTITION BY symbol ORDER BY round(abs(r), 9), time) AS vol_q, ntile(4) OVER (PARTITION BY symbol ORDER BY volume, time) AS liq_q FROM gr WHERE r IS NOT NULL) GROUP BY 1, 2", "gr"))
def ntile_regimes(m: Market):
    w = Window.partitionBy("symbol")
    q = X.with_returns(m.grid).filter("r IS NOT NULL").withColumns({"vol_q": F.ntile(4).over(w.orderBy(F.round(F.abs("r"), 9), "time")), "liq_q": F.ntile(4).over(w.orderBy("volume", "time"))})
    hit = F.count_if(F.col("r") > 0) / F.nullif(F.count_if(F.col("r") != 0), F.lit(0).cast("long"))
    return rounded(q.groupBy("vol_q", "liq_q").agg(F.count("*").alias("bars"), F.avg("r").alias("mean_r"), hit.alias("hit_rate")))


@query("every_kth", sql(f"SELECT time, symbol FROM (SELECT time, symbol, row_number() OVER ({_W}) AS k FROM db) WHERE k % 5 = 1", "db"))
def every_kth(m: Market):
    k = F.row_number().over(Window.partitionBy("symbol").orderBy("time"))
    return m.daily_bars.withColumn("k", k).filter("k % 5 = 1").select("time", "symbol")


@query("fwd_residual", sql(f"SELECT time, symbol, {rr('f AS forward', 'f - med AS residual')} FROM f JOIN (SELECT time, median(f) AS med FROM f GROUP BY time) USING (time)", "grid", extra={"f": f"SELECT time, symbol, CASE WHEN close > 0 AND lead(close, 3) OVER ({_W}) > 0 THEN ln(lead(close, 3) OVER ({_W}) / close) END AS f FROM grid"}))
def fwd_residual(m: Market):
    return rounded(X.forward_residual(m.grid, 3).select("time", "symbol", "forward", "residual"))


# ---- cross-section ---------------------------------------------------------------------------------


@query("centered_rank", sql(f"SELECT time, symbol, {rr('(row_number() OVER (PARTITION BY time ORDER BY close, symbol) - 1) / greatest(count(*) OVER (PARTITION BY time) - 1, 1) * 2.0 - 1.0 AS rank')} FROM db", "db"))
def centered_rank(m: Market):
    from strandline.functions.columns import centred_rank

    return m.daily_bars.select("time", "symbol", r(centred_rank("close", ["time"], "symbol")).alias("rank"))


_LIQ = {"lq0": "SELECT symbol, ln(1 + coalesce(avg(depth_usd), 0) + avg(volume * close) / 10) - coalesce(nullif(coalesce(avg(spread_bps), 0), 0), 8) / 20 AS liquidity_score FROM db GROUP BY symbol", "lq": "SELECT symbol, liquidity_score, least(greatest((((row_number() OVER (ORDER BY liquidity_score, symbol) - 1) / greatest(count(*) OVER () - 1, 1) * 2.0 - 1.0) + 1) / 2, 0.1), 1.0) AS liquidity_rank FROM lq0"}


@query("liquidity_rank", sql(f"SELECT symbol, {rr('liquidity_score', 'liquidity_rank')} FROM lq", "db", extra=_LIQ))
def liquidity_rank(m: Market):
    return rounded(R.liquidity_rank(m.daily_bars))


_w = R.Windows()
_RAW = {
    **_LIQ, **_MOVES,
    "s0": f"SELECT *, {_vol(_w.volatility)} AS volatility FROM gm",
    "s1": f"SELECT time, symbol, close, volatility, {_scaled(_w.fast)} AS fast_return, {_scaled(_w.medium)} AS medium_return, {_scaled(_w.slow)} AS slow_return, {_tstat(_w.regression)} AS slope, ({_gate('avg(close)', 'close', _w.fast)}) / ({_gate('avg(close)', 'close', _w.slow)}) - 1 AS ma_spread, {_ema_dist(_w.fast, 'volatility')} AS ema_fast, {_ema_dist(_w.medium, 'volatility')} AS ema_medium, {_ema_dist(_w.slow, 'volatility')} AS ema_slow, {_adx(_w.adx)} AS adx, ({_chg(_w.perturbation)}) / {_floor('volatility')} AS perturbation, funding_rate, {_chg(_w.medium, 'open_interest')} AS oi_momentum, spread_bps, depth_usd FROM s0",
    "sig": "SELECT s1.* REPLACE (coalesce(funding_rate, 0.0) AS funding_rate, coalesce(oi_momentum, 0.0) AS oi_momentum, coalesce(spread_bps, 8.0) AS spread_bps, coalesce(depth_usd, 0.0) AS depth_usd), coalesce(liquidity_rank, 0.5) AS liquidity_rank FROM s1 LEFT JOIN lq USING (symbol) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ("close", "volatility", "fast_return", "medium_return", "slow_return", "slope", "ma_spread", "ema_fast", "ema_medium", "ema_slow", "adx", "perturbation")),
}
_SIG = ["close", "volatility", "fast_return", "medium_return", "slow_return", "slope", "ma_spread", "ema_fast", "ema_medium", "ema_slow", "adx", "perturbation", "funding_rate", "oi_momentum", "spread_bps", "depth_usd", "liquidity_rank"]


def _signals(m: Market):
    return R.raw_signals(m.grid, R.liquidity_rank(m.daily_bars))


# Averages of given values tie at few digits: 9 for them, 3 for amounts of money (their rounding error is larger).
_FINE, _COARSE = [c for c in _SIG if c != "depth_usd"], ["depth_usd"]


@query("raw_signal", sql(f"SELECT time, symbol, {rr(*_FINE, digits=9)}, {rr(*_COARSE, digits=7)} FROM sig", "gr", extra=_RAW))
def raw_signal(m: Market):
    s = _signals(m)
    return s.select("time", "symbol", *[r(c, 9).alias(c) for c in _FINE], *[r(c, 7).alias(c) for c in _COARSE])


_rk = lambda c: f"(row_number() OVER (PARTITION BY time ORDER BY round({c}, 9), symbol) - 1) / greatest(count(*) OVER (PARTITION BY time) - 1, 1) * 2.0 - 1.0"
_VEC = {
    **_RAW,
    "v1": f"SELECT *, {', '.join(f'{_rk(c)} AS k_{c}' for c in R.RANKED)}, {_rk('-spread_bps')} AS k_spread, least(greatest((adx - 20.0) / 20.0, -1), 1) AS support FROM sig",
    "v2": "SELECT *, least(greatest((k_fast_return + k_medium_return + k_slow_return) / 3 * 0.5 + k_slope * 0.5, -1), 1) AS trend FROM v1",
    "v3": "SELECT *, CASE WHEN trend >= 0 THEN 1.0 ELSE -1.0 END AS d FROM v2",
    "v4": "SELECT *, least(greatest(d * (k_fast_return + k_medium_return + k_slow_return + k_slope) / 4, -1), 1) AS trend_agreement FROM v3",
    "vec": "SELECT time, symbol, trend, trend_agreement, least(greatest(-d * perturbation, 0), 1) AS pullback, -d * k_funding_rate AS funding_carry, d * k_funding_rate AS funding_alignment, d * k_oi_momentum AS open_interest, least((greatest(d * k_medium_return, 0) + greatest(d * k_oi_momentum, 0) + greatest(k_adx, 0) + greatest(support, 0)) / 4, 1) AS expansion, least((greatest(d * perturbation, 0) + greatest(d * k_funding_rate, 0) + greatest(-trend_agreement, 0)) / 3, 1) AS reversal_risk, (least(greatest(liquidity_rank, 0), 1) + least(greatest((k_spread + 1) / 2, 0), 1)) / 2 AS liquidity FROM v4",
}
_VCOLS = ["trend", "trend_agreement", "pullback", "funding_carry", "funding_alignment", "open_interest", "expansion", "reversal_risk", "liquidity"]


@query("feature_vector", sql(f"SELECT time, symbol, {rr(*_VCOLS, digits=5)} FROM vec", "gr", extra=_VEC))
def feature_vector(m: Market):
    return rounded(R.feature_vectors(_signals(m)), 5)


_RCOLS = ["breadth", "anchor_trend", "dispersion", "score", "realized_volatility", "liquidity_score", "funding_pressure", "open_interest_pressure"]


@query("regime", sql(f"SELECT time, {rr(*_RCOLS, digits=9)} FROM (SELECT *, (m + s + breadth + anchor_trend) / 4 AS score FROM (SELECT time, avg((km + ks) / 2) AS breadth, coalesce(avg((km + ks) / 2) FILTER (WHERE symbol IN ('click', 'view')), 0) AS anchor_trend, least(stddev_pop(medium_return), 5) / 5 AS dispersion, avg(km) AS m, avg(ks) AS s, avg(volatility) AS realized_volatility, avg(liquidity_rank) AS liquidity_score, avg(funding_rate) AS funding_pressure, avg(oi_momentum) AS open_interest_pressure FROM (SELECT *, {_rk('medium_return')} AS km, {_rk('slow_return')} AS ks FROM sig) GROUP BY time))", "gr", extra=_RAW))
def regime(m: Market):
    return rounded(R.regimes(_signals(m), ("click", "view")).select("time", *_RCOLS), 9)


_BETA = {"mk": "SELECT time, avg(r) AS market FROM gr GROUP BY time", "bj": "SELECT * FROM gr JOIN mk USING (time)", "be": f"SELECT time, symbol, r, market, CASE WHEN count(CASE WHEN r IS NOT NULL AND market IS NOT NULL THEN 1 END) OVER w = 12 THEN CASE WHEN var_pop(market) OVER w <= 1e-10 THEN 0.0 ELSE least(greatest(covar_pop(r, market) OVER w / var_pop(market) OVER w, -3), 3) END END AS beta FROM bj WINDOW w AS ({_W} ROWS 11 PRECEDING)"}


def _betas(m: Market):
    return R.rolling_beta(m.grid, R.market_proxy(m.grid), 12)


@query("rolling_beta", sql(f"SELECT time, symbol, {rr('r', 'market', 'beta', 'r - beta * market AS residual', digits=5)} FROM be", "gr", extra=_BETA))
def rolling_beta(m: Market):
    return rounded(_betas(m), 5)


@query("future_residual", sql(f"SELECT time, symbol, {rr('f AS future', 'f - med AS target', digits=5)} FROM fu JOIN (SELECT time, median(f) AS med FROM fu GROUP BY time) USING (time)", "gr", extra={**_BETA, "fu": f"SELECT time, symbol, CASE WHEN count(x) OVER w = 3 THEN sum(x) OVER w END AS f FROM (SELECT time, symbol, r - beta * market AS x FROM be) WINDOW w AS ({_W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"}))
def future_residual(m: Market):
    return rounded(R.future_residual(_betas(m), 3).select("time", "symbol", "future", "target"), 5)


_GX = ["fast_return", "slope", "perturbation"]
_GP = [(a, b) for i, a in enumerate(["one", *_GX, "close"]) for b in ["one", *_GX, "close"][i:]]


@query("gram", sql("SELECT symbol, " + rr(*[f"sum({'1.0' if a == 'one' else a} * {'1.0' if b == 'one' else b}) AS {a}__{b}" for a, b in _GP], digits=5) + " FROM sig GROUP BY symbol", "gr", extra=_RAW))
def gram(m: Market):
    return rounded(R.gram(_signals(m), ["symbol"], _GX, "close"), 5)  # squares of prices have four decimals: no ties


@query("ridge_fit")
def ridge_fit(m: Market):
    """The solve has no SQL form; the tests compare it with a direct least-squares fit."""
    return R.ridge(R.gram(_signals(m), ["symbol"], _GX, "close"), ["symbol"], _GX, "close")


@query("ridge_walk_forward")
def ridge_walk_forward(m: Market):
    return R.ridge(R.cumulative_gram(_signals(m), _GX, "close", 3), ["time"], _GX, "close", min_n=20)


_EDGE = {
    **_VEC,
    "e1": f"SELECT s.*, trend, trend_agreement, pullback, expansion, liquidity, trend * 0.01 AS sc FROM sig s JOIN vec USING (time, symbol)",
    "e2": f"SELECT *, {_rk('sc')} AS residual_rank, {_rk('-spread_bps')} AS sr FROM e1",
    "e3": "SELECT *, (least(abs(residual_rank), 1) + greatest(trend_agreement, 0) + least(greatest(pullback, 0), 1) + least(greatest(expansion, 0), 1) + least(greatest(liquidity, 0), 1) + 1.0 + (sr + 1) / 2) / 7 AS confidence FROM e2",
    "e4": "SELECT *, CASE WHEN confidence >= 0.8 THEN 0.8 WHEN confidence >= 0.6 THEN 0.55 ELSE 0.35 END AS mk, spread_bps * CASE WHEN confidence >= 0.75 THEN 0.35 ELSE 0.5 END AS half FROM e3",
    "e5": "SELECT *, 1.5 * mk + 4.5 * (1 - mk) + half + CASE WHEN depth_usd <= 0 THEN 4.0 ELSE least(40.0, sqrt(abs(confidence * 0.08) * 10000.0 / depth_usd) * 10.0) END + half * 0.08 + abs(funding_rate) * 10000.0 * 3.0 AS cost, 4.0 * confidence AS pen FROM e4",
    "ed": "SELECT *, sc * 10000.0 - cost - pen AS edge FROM e5",
}


def _edges(m: Market):
    raw = stored(_signals(m), "signals")
    return R.edge_estimates(raw, R.feature_vectors(raw), F.col("trend") * 0.01)


@query("edge_estimate", sql(f"SELECT time, symbol, {rr('sc AS empirical_score', 'confidence', 'cost AS expected_cost_bps', 'pen AS turnover_penalty_bps', 'edge AS expected_net_edge_bps', digits=7)} FROM ed", "gr", extra=_EDGE))
def edge_estimate(m: Market):
    return rounded(_edges(m).select("time", "symbol", "empirical_score", "confidence", "expected_cost_bps", "turnover_penalty_bps", "expected_net_edge_bps"), 7)


_ALLOC_IN = "SELECT time, symbol, close / 100.0 - 2.5 AS score, close / 10.0 AS edge, (CAST(num_trades AS DOUBLE) % 7) / 7.0 AS confidence, 0.02 + (CAST(num_trades AS DOUBLE) % 5) / 100.0 AS volatility, 0.5 AS liquidity, ((CAST(num_trades AS DOUBLE) % 3) - 1.0) * 0.03 AS cw, 2.0 AS pen FROM db"
_ALLOC = {
    "a0": _ALLOC_IN,
    "a1": "SELECT *, CASE WHEN score > 0 THEN 1 ELSE -1 END AS sd FROM a0 WHERE score <> 0",
    "a2": "SELECT *, cw * sd AS held, edge + CASE WHEN cw * sd > 1e-9 THEN pen WHEN cw * sd < -1e-9 THEN -pen ELSE 0 END + 4.0 * abs(cw) AS pri FROM a1",
    "a3": "SELECT *, row_number() OVER (PARTITION BY time, sd ORDER BY pri DESC, symbol) AS k, count(*) OVER (PARTITION BY time, sd) AS n FROM a2",
    "a4": "SELECT *, least(greatest(0.35 + 0.65 * avg(confidence) OVER (PARTITION BY time), 0.35), 1.0) AS exposure, greatest(edge + CASE WHEN held > 1e-9 THEN pen + 4.0 * abs(cw) ELSE 0 END, 0.05) * confidence * liquidity / greatest(volatility, 1e-4) AS raw FROM a3 WHERE k <= least(greatest(ceil(n * 0.5), 1), 8)",
    "a5": "SELECT *, least(0.5 * exposure / 2 * raw / greatest(sum(raw) OVER (PARTITION BY time, sd), 1e-4), 0.08) AS weight FROM a4",
    "a6": "SELECT *, abs(weight * sd - cw) AS turnover FROM a5",
    "a7": "SELECT *, edge - (CASE WHEN turnover <= 1e-9 THEN 0 ELSE 4.0 * turnover / 0.08 END - pen) AS adj FROM a6",
}


def _allocation(m: Market):
    n = F.col("num_trades").cast("double")
    s = m.daily_bars.select("time", "symbol", (F.col("close") / 100.0 - 2.5).alias("score"), (F.col("close") / 10.0).alias("expected_net_edge_bps"), (n % 7 / 7.0).alias("confidence"), (0.02 + n % 5 / 100.0).alias("volatility"), F.lit(0.5).alias("liquidity"), ((n % 3 - 1.0) * 0.03).alias("current_weight"), F.lit(2.0).alias("turnover_penalty_bps"))
    return R.allocate(s, quantile=0.5)


@query("allocate", sql(f"SELECT time, symbol, CASE WHEN sd = 1 THEN 'LONG' ELSE 'SHORT' END AS direction, {rr('weight', 'turnover', 'adj AS adjusted_edge_bps', 'exposure')} FROM a7 WHERE adj > 0", "db", extra=_ALLOC))
def allocate(m: Market):
    return rounded(_allocation(m))


@query("portfolio_returns", sql(f"SELECT time, {rr('ln(1 + sum(w * fwd)) AS r', 'sum(abs(w)) AS gross', 'sum(w) AS net', 'sum(turn) AS turnover')} FROM (SELECT *, abs(w - coalesce(lag(w) OVER ({_W}), 0)) AS turn FROM (SELECT time, symbol, weight * sd AS w FROM a7 WHERE adj > 0)) JOIN (SELECT time, symbol, lead(close) OVER ({_W}) / nullif(close, 0) - 1 AS fwd FROM db) USING (time, symbol) WHERE fwd IS NOT NULL GROUP BY time", "db", extra=_ALLOC))
def portfolio_returns(m: Market):
    w = _allocation(m).select("time", "symbol", F.when(F.col("direction") == "LONG", F.col("weight")).otherwise(-F.col("weight")).alias("weight"))
    forward = m.daily_bars.withColumn("forward", F.try_divide(F.lead("close").over(Window.partitionBy("symbol").orderBy("time")), F.col("close")) - 1.0).filter("forward IS NOT NULL").select("time", "symbol", "forward")
    return rounded(P.portfolio_returns(w, forward).select("time", "r", "gross", "net", "turnover"))


@query("leaderboard", "SELECT o_orderpriority AS strategy_name, o_orderstatus AS symbol, runs, round(avg_return, 6) + 0.0 AS avg_return, row_number() OVER (ORDER BY round(avg_return, 9) DESC, o_orderpriority, o_orderstatus) AS rank FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS runs, avg(o_totalprice / 100000.0 - 1) AS avg_return FROM orders GROUP BY 1, 2)")
def leaderboard(m: Market):
    g = m.runs.groupBy("strategy_name", "symbol").agg(F.count("*").alias("runs"), F.avg("net_return_pct").alias("avg_return"))
    return R.leaderboard(g, [F.desc(F.round("avg_return", 9)), F.asc("strategy_name"), F.asc("symbol")]).withColumn("avg_return", r("avg_return"))


@query("calibrate", "SELECT *, feasible AND row_number() OVER (ORDER BY feasible DESC, median_edge DESC, threshold) = 1 AS best FROM (SELECT threshold, count(*) FILTER (WHERE edge >= threshold) AS accepted, round(median(edge) FILTER (WHERE edge >= threshold), 6) + 0.0 AS median_edge, round(median(dd) FILTER (WHERE edge >= threshold), 6) + 0.0 AS median_drawdown, count(*) FILTER (WHERE edge >= threshold) >= 100 AS feasible FROM (SELECT o_totalprice / 100000.0 - 1 AS edge, CAST(o_custkey % 30 AS DOUBLE) AS dd FROM orders) CROSS JOIN (SELECT unnest([0.0::DOUBLE, 0.5, 1.0, 1.5, 2.0]) AS threshold) GROUP BY threshold)")
def calibrate(m: Market):
    return rounded(R.calibrate(m.runs.select(F.col("net_return_pct").alias("edge"), F.col("max_drawdown_pct").alias("drawdown")), [0.0, 0.5, 1.0, 1.5, 2.0], 100))


@query("sleeve_correlation")
def sleeve_correlation(m: Market):
    x = X.with_returns(m.grid).filter("r IS NOT NULL")
    return R.sleeve_correlation(x.select(F.date_trunc("month", "time").alias("key"), "time", F.col("symbol").alias("sleeve"), "r"))


# ---- performance -----------------------------------------------------------------------------------

_ret = lambda m: X.with_returns(m.daily_bars).filter("r IS NOT NULL").select("symbol", "time", "r", "volume")
_RET = {"rt": f"SELECT symbol, time, r, volume FROM (SELECT *, ln(close / lag(close) OVER ({_W})) AS r FROM db) WHERE r IS NOT NULL"}
_SCALE = repr((365 * 24 * 60 / 240) ** 0.5)


@query("performance", sql(f"""SELECT symbol, bars, start_time, end_time, {rr('(exp(s) - 1) * 100 AS net_return_pct', 'CASE WHEN v <= 1e-12 THEN 0 ELSE mu / sqrt(v) * ' + _SCALE + ' END AS sharpe', 'mdd AS max_drawdown_pct', 'ulcer AS ulcer_index', 'uw * 100 AS time_under_water_pct', 'cv AS cvar_1d_pct', digits=4)}, printf('%.5e', an) AS annualized, printf('%.5e', CASE WHEN mdd <= 1e-9 THEN an ELSE an / mdd END) AS calmar_ratio FROM
    (SELECT *, CASE WHEN epoch(end_time) > epoch(start_time) THEN (exp(s / ((epoch(end_time) - epoch(start_time)) / (365 * 24 * 3600.0))) - 1) * 100 ELSE 0 END AS an FROM
    (SELECT symbol, count(*) AS bars, min(time) AS start_time, max(time) AS end_time, sum(r) AS s, avg(r) AS mu, var_pop(r) AS v, max(dd) AS mdd, sqrt(avg(dd * dd)) AS ulcer, avg(CASE WHEN eq + 1e-9 < pk THEN 1.0 ELSE 0.0 END) AS uw FROM (SELECT *, (pk - eq) / pk * 100 AS dd FROM (SELECT *, greatest(max(eq) OVER ({_W}), 1.0) AS pk FROM (SELECT *, exp(sum(r) OVER ({_W})) AS eq FROM rt))) GROUP BY symbol))
    JOIN (SELECT symbol, avg(d) AS cv FROM (SELECT symbol, d, row_number() OVER (PARTITION BY symbol ORDER BY d) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT symbol, day, (exp(sum(r)) - 1) * 100 AS d FROM (SELECT *, floor((row_number() OVER ({_W}) - 1) / 6) AS day FROM rt) GROUP BY 1, 2)) WHERE k <= greatest(ceil(n * 0.05), 1) GROUP BY symbol) USING (symbol)""", "db", extra=_RET))
def performance(m: Market):
    p = P.performance(_ret(m), ["symbol"], 240)
    return rounded(p.select("symbol", "bars", "start_time", "end_time", "net_return_pct", "sharpe", "max_drawdown_pct", "ulcer_index", "time_under_water_pct", "cvar_1d_pct", F.format_string("%.5e", "annualized_return_pct").alias("annualized"), F.format_string("%.5e", "calmar").alias("calmar_ratio")), 4)


@query("regime_slices", sql(f"""SELECT symbol, bucket, count(*) AS bars, {rr('(exp(sum(r)) - 1) * 100 AS net_return_pct', 'CASE WHEN var_pop(r) <= 1e-12 THEN 0 ELSE avg(r) / sqrt(var_pop(r)) * ' + _SCALE + ' END AS sharpe', digits=4)} FROM (SELECT rt.*, unnest(list_filter([CASE WHEN volume <= lo THEN 'low' END, CASE WHEN volume > lo AND volume < hi THEN 'mid' END, CASE WHEN volume >= hi THEN 'high' END], lambda x: x IS NOT NULL)) AS bucket
    FROM rt JOIN (SELECT symbol, list_sort(list(volume))[CAST(floor((count(*) - 1) * 0.33) AS BIGINT) + 1] AS lo, list_sort(list(volume))[CAST(floor((count(*) - 1) * 0.67) AS BIGINT) + 1] AS hi FROM rt GROUP BY symbol) USING (symbol)) GROUP BY 1, 2""", "db", extra=_RET))
def regime_slices(m: Market):
    return rounded(P.tercile_slices(_ret(m), ["symbol"], "volume", 240), 4)


@query("purged_folds", sql("""SELECT fold, block, first_bar, last_bar, start_time, end_time, CASE WHEN block >= s AND block < s + 2 THEN 'active' WHEN block >= s - 1 AND block < s + 3 THEN 'purge' ELSE 'train' END AS role FROM bl CROSS JOIN (SELECT p + 1 AS fold, CAST(floor(p * (n - 2) / 3.0 + 0.5) AS BIGINT) AS s FROM (SELECT unnest(generate_series(0, 3)) AS p), (SELECT count(*) AS n FROM bl))""", "db", extra={"bl": "SELECT CAST(floor((i - 10) / 12) AS INT) AS block, min(i) AS first_bar, max(i) AS last_bar, min(time) AS start_time, max(time) AS end_time FROM (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i FROM (SELECT DISTINCT time FROM db)) WHERE i >= 10 GROUP BY 1"}))
def purged_folds(m: Market):
    return P.purged_folds(m.daily_bars, 10, 4, 12, 2, 1)


@query("by_qvalues", """SELECT c_custkey, round(min(a) OVER (PARTITION BY c_nationkey ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS q_value FROM (SELECT *, least(p * n * h / k, 1.0) AS a FROM (SELECT c_custkey, c_nationkey, p, n, row_number() OVER (PARTITION BY c_nationkey ORDER BY p, c_custkey) AS k, list_sum(list_transform(range(1, n + 1), lambda i: 1.0::DOUBLE / i)) AS h FROM (SELECT c_custkey, c_nationkey, (c_acctbal + 1000) / 11000.0 AS p0, least(greatest((c_acctbal + 1000) / 11000.0, 0), 1) AS p, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)))""")
def by_qvalues(m: Market):
    c = m.table("customer").withColumn("p", (F.col("c_acctbal") + 1000) / 11000.0)
    return P.by_q_values(c, ["c_nationkey"], "p", "c_custkey").select("c_custkey", r("q_value").alias("q_value"))


_ERF = "(1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z / 2))"


@query("psr_dsr", sql(f"SELECT symbol, n, {rr('sharpe', 'skew', 'kurtosis', 'z AS psr_z', f'least(greatest(1 - 0.5 * (1 + CASE WHEN z < 0 THEN -{_ERF} ELSE {_ERF} END), 0), 1) AS p_value', digits=5)} FROM (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) AS t FROM (SELECT *, sharpe * sqrt(n - 1) / sqrt(greatest(1 - skew * sharpe + (kurtosis - 1) * sharpe * sharpe / 4, 1e-9)) AS z FROM (SELECT symbol, n, mu / sd AS sharpe, avg(power((r - mu) / sd, 3)) AS skew, avg(power((r - mu) / sd, 4)) AS kurtosis FROM rt JOIN (SELECT symbol, count(*) AS n, avg(r) AS mu, stddev_samp(r) AS sd FROM rt GROUP BY symbol) USING (symbol) GROUP BY symbol, n, mu, sd)))", "db", extra=_RET))
def psr_dsr(m: Market):
    return rounded(P.probabilistic_sharpe(P.sharpe_moments(_ret(m), ["symbol"]), F.lit(0.0)), 5)


def _folded(coefficients, x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _inverse(p: str) -> str:
    """DuckDB: the inverse normal distribution by the same fixed constants."""
    tail = lambda r: f"{_folded(K._C, r)} / {_folded((*K._D, 1.0), r)}"
    low, high, q = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - ({p})))", f"(({p}) - 0.5)"
    return f"CASE WHEN ({p}) < 0.02425 THEN {tail(low)} WHEN ({p}) > 1 - 0.02425 THEN -({tail(high)}) ELSE {_folded(K._A, f'({q} * {q})')} * {q} / {_folded((*K._B, 1.0), f'({q} * {q})')} END"


_DSR = {
    **_RET,
    "mo": "SELECT symbol, n, mu / sd AS sharpe, avg(power((r - mu) / sd, 3)) AS skew, avg(power((r - mu) / sd, 4)) AS kurtosis FROM rt JOIN (SELECT symbol, count(*) AS n, avg(r) AS mu, stddev_samp(r) AS sd FROM rt GROUP BY symbol) USING (symbol) GROUP BY symbol, n, mu, sd",
    "be": f"SELECT trials, m + d * ((1 - {P.EULER_GAMMA}) * z1 + {P.EULER_GAMMA} * z2) AS benchmark FROM (SELECT *, {_inverse('1 - 1.0 / trials')} AS z1, {_inverse('1 - 1 / (trials * exp(1.0))')} AS z2 FROM (SELECT greatest(count(*), 2) AS trials, avg(sharpe) AS m, stddev_samp(sharpe) AS d FROM mo))",
    "zz": "SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) AS t FROM (SELECT *, (sharpe - benchmark) * sqrt(n - 1) / sqrt(greatest(1 - skew * sharpe + (kurtosis - 1) * sharpe * sharpe / 4, 1e-9)) AS z FROM mo CROSS JOIN be)",
}


@query("deflated_sharpe", sql(f"SELECT 'all' AS family, symbol, n, trials, {rr('sharpe', 'skew', 'kurtosis', 'benchmark', 'z AS psr_z', f'least(greatest(1 - 0.5 * (1 + CASE WHEN z < 0 THEN -{_ERF} ELSE {_ERF} END), 0), 1) AS p_value', digits=5)} FROM zz", "db", extra=_DSR))
def deflated_sharpe(m: Market):
    mo = P.sharpe_moments(_ret(m), ["symbol"]).withColumn("family", F.lit("all"))
    return rounded(P.probabilistic_sharpe(mo.join(P.deflated_benchmark(mo, ["family"]), "family"), F.col("benchmark")), 5)


@query("bootstrap")
def bootstrap(m: Market):
    return P.bootstrap(_ret(m), ["symbol"])


@query("reality_check")
def reality_check(m: Market):
    return P.reality_check(_ret(m).select(F.col("symbol").alias("candidate"), "time", "r"))


@query("participation", sql(f"SELECT symbol, {rr('coalesce(count(*) FILTER (WHERE abs(g) >= 0.3 AND nt * sign(g) > 0) / nullif(count(*) FILTER (WHERE abs(g) >= 0.3), 0), 0) AS aligned_participation', 'coalesce(avg(greatest(-nt * sign(g), 0)) FILTER (WHERE abs(g) >= 0.3) * 100, 0) AS wrong_way_pct', 'max(abs(nt)) AS max_gross')} FROM (SELECT symbol, (close - 250) / 250 AS g, (CAST(num_trades AS DOUBLE) % 5 - 2) / 10 AS nt FROM db) GROUP BY symbol", "db"))
def participation(m: Market):
    net = (F.col("num_trades").cast("double") % 5 - 2) / 10
    return rounded(P.participation(m.daily_bars.select("symbol", ((F.col("close") - 250) / 250).alias("regime"), net.alias("net"), F.abs(net).alias("gross")), ["symbol"], 0.3))


_STEPS_521 = ("close AS a, close AS b", f"{_alpha(5)} * o.close + (1 - {_alpha(5)}) * e.a, {_alpha(21)} * o.close + (1 - {_alpha(21)}) * e.b")


@query("ema_backtest", _recursive(f"""SELECT symbol, time, {rr('position', 'sr AS strategy_ret', 'eq AS equity', 'eq / max(eq) OVER (PARTITION BY symbol ORDER BY time) - 1 AS drawdown', digits=8)} FROM (SELECT *, exp(sum(ln(1 + sr)) OVER ({_W})) AS eq FROM
    (SELECT *, greatest(-0.9999, position * ret - abs(position - coalesce(lag(position) OVER ({_W}), 0)) * 6 / 10000.0) AS sr FROM (SELECT *, coalesce(lag(CASE WHEN a > b AND vol <= mv THEN 1.0 ELSE 0.0 END) OVER ({_W}), 0) AS position FROM
    (SELECT *, avg(vol) OVER ({_W}) AS mv FROM (SELECT *, stddev_pop(ret) OVER ({_W} ROWS 59 PRECEDING) AS vol FROM (SELECT e.symbol, e.time, a, b, coalesce(o.close / nullif(lag(o.close) OVER (PARTITION BY e.symbol ORDER BY e.time), 0) - 1, 0) AS ret FROM e JOIN o ON o.symbol = e.symbol AND o.k = e.k))))))""", *_STEPS_521))
def ema_backtest(m: Market):
    done = P.cross_backtest(X.ema(m.daily_bars.select("symbol", "time", "close"), {"ema_fast": 5, "ema_slow": 21}))
    return rounded(done.select("symbol", "time", "position", "strategy_ret", "equity", "drawdown"), 8)


@query("sweep", sql(f"""SELECT symbol, fast, slow, {rr('exp(sum(CASE WHEN i <= floor(n * 0.7::DOUBLE) THEN ln(1 + net) ELSE 0 END)) - 1 AS train_return', 'exp(sum(CASE WHEN i > floor(n * 0.7::DOUBLE) THEN ln(1 + net) ELSE 0 END)) - 1 AS test_return', digits=8)} FROM (SELECT *, greatest(pos * ret - abs(pos - coalesce(lag(pos) OVER pw, 0)) * 6 / 10000.0, -0.9999) AS net FROM (SELECT *, coalesce(lag(CASE WHEN fa - sa > 1e-9 THEN 1.0 ELSE 0.0 END) OVER pw, 0) AS pos FROM sg WINDOW pw AS (PARTITION BY symbol, fast, slow ORDER BY time)) WINDOW pw AS (PARTITION BY symbol, fast, slow ORDER BY time)) GROUP BY 1, 2, 3""", "db", extra={
    "sa0": f"SELECT symbol, time, coalesce(close / nullif(lag(close) OVER ({_W}), 0) - 1, 0) AS ret, row_number() OVER ({_W}) AS i, count(*) OVER (PARTITION BY symbol) AS n, {', '.join(f'avg(close) OVER ({_W} ROWS {n - 1} PRECEDING) AS a{n}' for n in (3, 5, 10, 20))} FROM db",
    "sg": " UNION ALL ".join(f"SELECT symbol, time, ret, i, n, {f} AS fast, {s} AS slow, a{f} AS fa, a{s} AS sa FROM sa0" for f in (3, 5) for s in (10, 20)),
}))
def sweep(m: Market):
    return rounded(P.sweep(m.daily_bars, [3, 5], [10, 20]), 8)


@query("walkforward", sql(f"SELECT symbol, window_id, {rr('sum(CASE WHEN f < 0.7 THEN r ELSE 0 END) AS train_return', 'sum(CASE WHEN f >= 0.7 THEN r ELSE 0 END) AS test_return')}, count(*) AS bars FROM (SELECT *, (epoch(time) - window_id * 86400) / 259200.0 AS f FROM (SELECT *, unnest(generate_series(CAST(floor(epoch(time) / 86400) AS BIGINT) - 2, CAST(floor(epoch(time) / 86400) AS BIGINT))) AS window_id FROM rt)) GROUP BY 1, 2", "db", extra=_RET))
def walkforward(m: Market):
    return rounded(P.walk_forward(_ret(m)))


# ---- costs and runs --------------------------------------------------------------------------------


@query("drift", sql(f"""SELECT strategy_name, symbol, observed_at, order_key, {rr('-total_cost_bps AS live_edge_bps', 'e AS backtest_edge_bps', '(avg(fill_ratio) OVER k - fill_ratio) * 10000 AS fill_quality_delta_bps', 'slippage_bps - avg(slippage_bps) OVER k AS slippage_drift_bps', digits=4)} FROM
    (SELECT *, 0.8 + requested / 500.0 AS fill_ratio FROM costs) LEFT JOIN (SELECT strategy_name, arg_max(CASE WHEN trades > 0 THEN net_return_pct * 100 / trades ELSE net_return_pct * 100 END, run_id) AS e FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'A' WHEN o_orderstatus = 'O' THEN 'N' ELSE 'R' END AS strategy_name, trades, net_return_pct, run_id FROM runs JOIN orders ON run_id = o_orderkey) GROUP BY 1) USING (strategy_name) WINDOW k AS (PARTITION BY strategy_name, symbol)""", "costs", "runs"))
def drift(m: Market):
    costs = m.costs.select("strategy_name", "exchange", "symbol", "observed_at", "slippage_bps", "total_cost_bps", "order_key", (0.8 + F.col("requested") / 500.0).alias("fill_ratio"))
    order = F.when(F.col("symbol") == "F", "A").when(F.col("symbol") == "O", "N").otherwise("R")
    best = m.runs.withColumn("strategy_name", order).groupBy("strategy_name").agg(F.max_by(F.when(F.col("trades") > 0, F.col("net_return_pct") * 100 / F.col("trades")).otherwise(F.col("net_return_pct") * 100), "run_id").alias("backtest_edge_bps"))
    d = P.against_means(costs, ["strategy_name", "symbol"], ["fill_ratio", "slippage_bps"]).join(best, "strategy_name", "left")
    d = d.withColumns({"live_edge_bps": -F.col("total_cost_bps"), "fill_quality_delta_bps": -F.col("fill_ratio_delta") * 10000.0, "slippage_drift_bps": F.col("slippage_bps_delta")})
    return rounded(d.select("strategy_name", "symbol", "observed_at", "order_key", "live_edge_bps", "backtest_edge_bps", "fill_quality_delta_bps", "slippage_drift_bps"), 4)


@query("sensitivity", sql(f"SELECT strategy_name, friction, {rr('avg(total_cost_bps * friction) AS avg_cost_bps', 'avg(10.0 - total_cost_bps * friction) AS avg_edge_bps')}, count(*) AS rows FROM costs CROSS JOIN (SELECT unnest([0.5::DOUBLE, 1.0, 1.5, 2.0]) AS friction) GROUP BY 1, 2", "costs"))
def sensitivity(m: Market):
    return rounded(P.sensitivity(m.costs, [0.5, 1.0, 1.5, 2.0]))


@query("cost_report", sql(f"SELECT strategy_name, exchange, side, fee_tier, count(*) AS rows, {rr(*[f'avg({c}) AS avg_{c}' for c in ('slippage_bps', 'fee_bps', 'total_cost_bps')])} FROM costs GROUP BY 1, 2, 3, 4", "costs"))
def cost_report(m: Market):
    return rounded(C.cost_report(m.costs))


@query("exec_baseline", sql(f"SELECT strategy_name, {rr('avg(total_cost_bps) AS avg_total_cost_bps', 'avg(slippage_bps) AS avg_slippage_bps', 'avg(CASE WHEN order_key % 3 <> 0 THEN requested / 50.0 END) AS avg_fill_ratio')} FROM costs GROUP BY 1", "costs"))
def exec_baseline(m: Market):
    fill = F.when(F.col("order_key") % 3 == 0, F.lit('{"fillRatio": "n/a"}')).otherwise(F.concat(F.lit('{"fillRatio": '), (F.col("requested") / 50.0).cast("string"), F.lit("}")))
    return rounded(C.execution_baseline(m.costs.withColumn("metadata", fill), m.runs.filter("false")).drop("backtest_edge_bps"))


@query("monthly_runs", sql(f"SELECT date_trunc('month', run_at) AS month, count(*) AS runs, {rr('avg(net_return_pct) AS avg_return_pct', 'median(net_return_pct) AS median_return_pct', 'max(max_drawdown_pct) AS worst_drawdown_pct', digits=9)} FROM runs GROUP BY 1", "runs"))
def monthly_runs(m: Market):
    return rounded(C.monthly_runs(m.runs), 9)


@query("walk_forward_seed", sql(f'SELECT strategy_name, symbol, min(run_at) AS start, max(run_at) AS "end", count(*) AS runs, {rr("avg(net_return_pct) AS avg_return_pct")} FROM runs GROUP BY 1, 2 ORDER BY max(run_at) DESC, 1, 2 LIMIT 40', "runs"))
def walk_forward_seed(m: Market):
    return rounded(C.walk_forward_seed(m.runs))


@query("fills_summary", sql(f"""SELECT *, concat_ws(',', CASE WHEN fill_ratio < 0.95 THEN 'fill_ratio' END, CASE WHEN avg_slippage_bps > 0.01 THEN 'slippage' END, CASE WHEN latency_p95_ms > 900 THEN 'latency' END) AS alerts FROM (SELECT strategy_name, {rr('sum(0.9 * requested) / sum(requested) AS fill_ratio', "avg(CASE WHEN side = 'buy' THEN ((1 + slippage_bps / 10000) - 1) * 10000 ELSE (1 / (1 + slippage_bps / 10000) - 1) * 10000 END) AS avg_slippage_bps", 'avg(fee_bps) AS fee_bps')}, list_sort(list(order_key % 997))[CAST(floor((count(*) - 1) * 0.5) AS BIGINT) + 1] AS latency_p50_ms, list_sort(list(order_key % 997))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] AS latency_p95_ms FROM costs GROUP BY 1)""", "costs"))
def fills_summary(m: Market):
    f = m.costs.select("strategy_name", F.when(F.col("side") == "buy", "LONG").otherwise("SHORT").alias("direction"), (F.col("requested") * 0.9).alias("filled"), F.col("requested").alias("planned"), F.lit(1.0).alias("expected_price"), (1.0 + F.col("slippage_bps") / 10_000).alias("executed_price"), "fee_bps", (F.col("order_key") % 997).alias("latency_ms"))
    return rounded(C.fills_summary(f, ["strategy_name"], floor=0.95, slip_bps=0.01, latency_ms=900).withColumn("alerts", F.array_join("alerts", ",")))


@query("strategy_perf", sql(f"SELECT strategy_name, trades, wins, {rr('avg_win', 'avg_loss', 'wins / trades AS win_rate', 'CASE WHEN l > 0 THEN g / l WHEN g > 0 THEN 999.0 ELSE 0.0 END AS profit_factor', 'CASE WHEN sd > 0 THEN mu / sd * sqrt(trades) ELSE 0 END AS sharpe')} FROM (SELECT strategy_name, count(*) AS trades, count(*) FILTER (WHERE x > 0) AS wins, avg(x) FILTER (WHERE x > 0) AS avg_win, avg(x) FILTER (WHERE x < 0) AS avg_loss, coalesce(sum(x) FILTER (WHERE x > 0), 0) AS g, coalesce(-sum(x) FILTER (WHERE x < 0), 0) AS l, avg(x) AS mu, stddev_pop(x) AS sd FROM (SELECT strategy_name, net_return_pct AS x FROM runs) GROUP BY 1)", "runs"))
def strategy_perf(m: Market):
    return rounded(P.strategy_performance(m.runs))


@query("position_size", "SELECT p_partkey, m AS method, floor(greatest(least(CASE m WHEN 'fixed' THEN p_size WHEN 'percent' THEN 100000 * 5 / 100.0 / p_retailprice WHEN 'kelly' THEN 100000 * ((2.0 * 0.55 - 0.45) / 2.0 * 0.25) / p_retailprice WHEN 'atr' THEN 100000 * 5 / 100.0 / (p_retailprice / 50 * 2) ELSE 100000 * 5 / 100.0 / p_retailprice END, 100000 * 20 / 100.0 / p_retailprice), 0) * 1e8) / 1e8 AS size FROM (SELECT *, ['fixed', 'percent', 'kelly', 'atr', 'volatility'][p_partkey % 5 + 1] AS m FROM part)")
def position_size(m: Market):
    p = m.table("part").select("p_partkey", F.element_at(F.array(*[F.lit(x) for x in ("fixed", "percent", "kelly", "atr", "volatility")]), (F.col("p_partkey") % 5 + 1).cast("int")).alias("method"), F.col("p_retailprice").alias("entry_price"), F.col("p_size").cast("double").alias("fixed_size"), F.lit(100000.0).alias("equity"), F.lit(5.0).alias("percent"), F.lit(2.0).alias("avg_win"), F.lit(1.0).alias("avg_loss"), F.lit(0.55).alias("win_rate"), F.lit(0.25).alias("kelly_fraction"), (F.col("p_retailprice") / 50).alias("atr"), F.lit(2.0).alias("atr_multiple"))
    return C.position_size(p).select("p_partkey", "method", "size")


@query("stops_targets", "SELECT p_partkey, side, round(stop, 6) + 0.0 AS stop, round(t1, 6) + 0.0 AS target_1, round(t2, 6) + 0.0 AS target_2, CASE WHEN p_size >= 45 THEN 'max_positions' WHEN p_retailprice * p_size / 100000 * 100 > 20 THEN 'size_limit' END AS reason FROM (SELECT *, CASE WHEN side = 'long' THEN e + abs(e - stop) * 1.5 ELSE e - abs(e - stop) * 1.5 END AS t1, CASE WHEN side = 'long' THEN e + abs(e - stop) * 3 ELSE e - abs(e - stop) * 3 END AS t2 FROM (SELECT *, p_retailprice AS e, CASE WHEN side = 'long' THEN p_retailprice * 0.95 ELSE p_retailprice * 1.05 END AS stop FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'long' ELSE 'short' END AS side FROM part)))")
def stops_targets(m: Market):
    p = m.table("part").withColumn("side", F.when(F.col("p_partkey") % 2 == 0, "long").otherwise("short"))
    e = F.col("p_retailprice")
    p = p.withColumn("stop", C.stop_price(e, F.col("side"), e * 0.05)).withColumn("t", C.targets(e, F.col("stop"), F.col("side"), [(1.5, 50), (3.0, 50)]))
    p = C.check_position(p.withColumns({"open_positions": F.col("p_size"), "position_value": e * F.col("p_size"), "equity": F.lit(100000.0)}), 45, 20.0)
    return p.select("p_partkey", "side", r("stop").alias("stop"), r(F.col("t")[0]["price"]).alias("target_1"), r(F.col("t")[1]["price"]).alias("target_2"), "reason")


@query("child_orders", "SELECT p_partkey, style, sequence, slices, round(w * CASE WHEN style = 'MAKER_RAMP' THEN sequence / (slices * (slices + 1) / 2.0) ELSE 1.0 / slices END, 6) + 0.0 AS child_weight, CAST(floor(120 * (sequence - 1) / slices) AS INT) AS trigger_minutes FROM (SELECT *, unnest(generate_series(1, slices)) AS sequence FROM (SELECT p_partkey, p_size / 500.0 AS w, CAST(greatest(ceil(p_size / 500.0 / 0.02), 1) AS INT) AS slices, CASE WHEN c >= 0.8 THEN 'MAKER_RAMP' WHEN c >= 0.6 THEN 'TWAP' WHEN c >= 0.4 THEN 'POV' ELSE 'VWAP_TRACK' END AS style FROM (SELECT *, (p_partkey % 11) / 10.0 AS c FROM part)))")
def child_orders(m: Market):
    p = m.table("part").select("p_partkey", (F.col("p_size") / 500.0).alias("weight"), (F.col("p_partkey") % 11 / 10.0).alias("confidence"))
    return C.child_orders(p).select("p_partkey", "style", "sequence", "slices", r("child_weight").alias("child_weight"), "trigger_minutes")


@query("plan_cost", f"SELECT p_partkey, {rr('1.5 * m + 4.5 * (1 - m) + 4.0 * CASE WHEN m = 0.8 THEN 0.35 ELSE 0.5 END + 3.0 / n AS estimated_cost_bps', 'm AS estimated_maker_share')}, n AS child_orders FROM (SELECT p_partkey, CAST(greatest(ceil(p_size / 500.0 / 0.02), 1) AS BIGINT) AS n, CASE WHEN p_partkey % 11 >= 8 THEN 0.8 WHEN p_partkey % 11 >= 6 THEN 0.5 WHEN p_partkey % 11 >= 4 THEN 0.35 ELSE 0.4 END AS m FROM part)")
def plan_cost(m: Market):
    p = m.table("part").select("p_partkey", (F.col("p_size") / 500.0).alias("weight"), (F.col("p_partkey") % 11 / 10.0).alias("confidence"))
    return rounded(C.plan_cost(C.child_orders(p), ["p_partkey"]))
