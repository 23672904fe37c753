"""Cross-sectional research: rankings, signals, ranks and feature vectors, regimes, betas, edges, fits and portfolios."""

from __future__ import annotations

from dataclasses import dataclass
from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.columns import centred_rank, clamp, floor_quantile, frame, safe_divide
from strandline.operators import features as X

# ---- rankings ------------------------------------------------------------------------------------


def sentiment_by_symbol(sentiment: DataFrame) -> DataFrame:
    return sentiment.groupBy("symbol").agg(F.avg("sentiment_score").alias("sentiment_score"), F.avg("confidence").alias("sentiment_confidence"))


def _momentum(bars: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("time")
    return bars.withColumn("prev", F.lag("close").over(w))


def _range_and_up(bars: DataFrame) -> DataFrame:
    return _momentum(bars, ["symbol"]).groupBy("symbol").agg(
        F.coalesce(safe_divide(F.max("close") - F.min("close"), F.min("close")), F.lit(0.0)).alias("return_ratio"),
        (F.count_if(F.col("close") > F.col("prev")) / F.count("*")).alias("up_ratio"),
        F.coalesce(F.stddev_pop(F.when(F.col("prev").isNotNull(), safe_divide(F.col("close") - F.col("prev"), F.col("prev"))).otherwise(0.0)), F.lit(0.0)).alias("realized_vol"),
    )


def alpha_candidates(bars: DataFrame, sentiment: DataFrame, top: int = 20) -> DataFrame:
    """``100 range + 25 up + 20 sentiment + 5 confidence``; sentiment joins on the base symbol (T12). Ties by symbol."""
    s = sentiment_by_symbol(sentiment).withColumnRenamed("symbol", "base")
    j = _range_and_up(bars).drop("realized_vol").withColumn("base", F.split("symbol", "-")[0]).join(s, "base", "left").fillna(0.0, ["sentiment_score", "sentiment_confidence"])
    score = F.col("return_ratio") * 100.0 + F.col("up_ratio") * 25.0 + F.col("sentiment_score") * 20.0 + F.col("sentiment_confidence") * 5.0
    return j.drop("base").withColumn("alpha_score", score).orderBy(F.desc("alpha_score"), "symbol").limit(top)


def trade_setups(bars: DataFrame, trades: DataFrame, books: DataFrame, sentiment: DataFrame, min_trades: int = 50, top: int = 10) -> DataFrame:
    """R2: setups by score, with side and regime; sentiment joins on the raw symbol."""
    t = trades.groupBy("symbol").agg(F.count("*").alias("trade_count"), F.avg("size").alias("avg_trade_size"))
    b = books.groupBy("symbol").agg(F.avg("spread_pct").alias("avg_spread_pct"))
    j = _range_and_up(bars).join(t, "symbol").join(b, "symbol", "left").join(sentiment_by_symbol(sentiment), "symbol", "left").fillna(0.0, ["avg_spread_pct", "sentiment_score", "sentiment_confidence"])
    score = F.col("return_ratio") * 100.0 + F.col("up_ratio") * 20.0 + F.col("sentiment_score") * 20.0 + F.col("sentiment_confidence") * 5.0 - F.col("realized_vol") * 300.0 - F.col("avg_spread_pct") * 0.75
    regime = F.when((F.col("return_ratio") >= 0.01) & (F.col("up_ratio") >= 0.55), "BULL_TREND").when((F.col("return_ratio") <= -0.01) & (F.col("up_ratio") <= 0.45), "BEAR_TREND").otherwise("RANGE")
    out = j.filter(F.col("trade_count") >= min_trades).withColumn("setup_score", score)
    return out.withColumns({"suggested_side": F.when(F.col("setup_score") >= 0, "BUY").otherwise("SELL"), "regime": regime}).orderBy(F.desc("setup_score"), "symbol").limit(top)


def venue_mux(bars: DataFrame, sentiment: DataFrame, top: int = 30) -> DataFrame:
    """Momentum and volume by venue, spread across venues, and their mixed score."""
    step = F.when(F.col("prev").isNotNull(), safe_divide(F.col("close") - F.col("prev"), F.col("prev"))).otherwise(0.0)
    px = _momentum(bars, ["exchange", "symbol"]).groupBy("exchange", "symbol").agg(F.max("close").alias("px"), F.coalesce(F.sum(step), F.lit(0.0)).alias("mom"), F.sum("volume").alias("vol"), F.count("*").alias("bars"))
    s = px.groupBy("symbol").agg(F.count("*").alias("exchange_count"), F.coalesce(safe_divide(F.max("px") - F.min("px"), F.min("px")), F.lit(0.0)).alias("cross_spread_pct"), F.sum("vol").alias("total_vol"), F.sum("bars").alias("total_bars"), F.avg("mom").alias("avg_momentum"))
    ss = sentiment_by_symbol(sentiment).select(F.col("symbol").alias("base"), F.col("sentiment_score").alias("sentiment"))
    j = s.withColumn("base", F.split("symbol", "-")[0]).join(ss, "base", "left").fillna(0.0, ["sentiment"]).drop("base")
    score = F.col("cross_spread_pct") * 60.0 + F.col("avg_momentum") * 25.0 + F.col("sentiment") * 15.0 + F.ln(1.0 + F.greatest("total_vol", F.lit(0.0))) * 2.0
    return j.withColumn("mux_score", score).orderBy(F.desc("mux_score"), "symbol").limit(top)


def momentum_rank(bars: DataFrame, sentiment: DataFrame, short: int = 30, long: int = 240, least: int = 120, smooth: int = 20) -> DataFrame:
    """``(0.4 short + 0.6 long) / vol + 0.75 sentiment`` of each symbol's latest bar, where there are enough bars."""
    w = Window.partitionBy("symbol").orderBy("time")
    change = lambda n: F.try_divide(F.col("close"), F.lag("close", n).over(w)) - 1.0
    p = bars.withColumn("ret", F.coalesce(change(1), F.lit(0.0))).withColumns({"mom_short": change(short), "mom_long": change(long), "vol": X._over(F.stddev_samp("ret"), "ret", long), "n": F.count("*").over(Window.partitionBy("symbol")), "k": F.row_number().over(w)})
    last = p.filter((F.col("k") == F.col("n")) & (F.col("n") >= least)).select("symbol", "close", "mom_short", "mom_long", "vol")
    sw = Window.partitionBy("symbol").orderBy("observed_at", "source")
    s = sentiment.withColumns({"roll": F.avg("sentiment_score").over(sw.rowsBetween(-(smooth - 1), 0)), "k": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("observed_at"), F.desc("source")))}).filter("k = 1").select("symbol", F.col("roll").alias("sentiment"))
    vol = F.when(F.col("vol") > 0, F.col("vol")).otherwise(1e-6)
    j = last.join(s, "symbol", "left").fillna(0.0, ["sentiment"])
    return j.withColumn("vol", vol).withColumn("alpha_score", (F.col("mom_short") * 0.4 + F.col("mom_long") * 0.6) / F.col("vol") + F.col("sentiment") * 0.75)


# ---- signals -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Windows:
    fast: int = 3
    medium: int = 6
    slow: int = 12
    volatility: int = 6
    regression: int = 8
    adx: int = 6
    perturbation: int = 2


def liquidity_rank(bars: DataFrame) -> DataFrame:
    """``ln(1 + depth + turnover / 10) - spread / 20`` over all bars of a symbol, ranked into [0.1, 1]."""
    s = bars.groupBy("symbol").agg(F.coalesce(F.avg("depth_usd"), F.lit(0.0)).alias("d"), F.coalesce(F.avg("spread_bps"), F.lit(0.0)).alias("s"), F.avg(F.col("volume") * F.col("close")).alias("t"))
    scored = s.withColumn("liquidity_score", F.ln(1.0 + F.col("d") + F.col("t") / 10.0) - F.when(F.col("s") > 0, F.col("s")).otherwise(8.0) / 20.0).withColumn("_all", F.lit(1))
    return scored.withColumn("liquidity_rank", clamp((centred_rank("liquidity_score", ["_all"], "symbol") + 1.0) / 2.0, 0.1, 1.0)).select("symbol", "liquidity_score", "liquidity_rank")


def raw_signals(grid: DataFrame, ranks: DataFrame, w: Windows = Windows()) -> DataFrame:
    """The windowed features of each (time, symbol) of the panel grid; rows with an incomplete window are dropped."""
    df = X.with_directional_moves(X.with_returns(grid)).withColumn("volatility", X.rolling_volatility(w.volatility))
    vol = F.col("volatility")
    df = df.withColumns({
        "fast_return": X.scaled_return(w.fast), "medium_return": X.scaled_return(w.medium), "slow_return": X.scaled_return(w.slow), "slope": X.t_statistic(w.regression), "ma_spread": X.sma_spread(w.fast, w.slow),
        "ema_fast": X.ema_distance(w.fast, vol), "ema_medium": X.ema_distance(w.medium, vol), "ema_slow": X.ema_distance(w.slow, vol), "adx": X.directional_index(w.adx), "perturbation": X.perturbation(w.perturbation, vol), "oi_momentum": X.interest_momentum(w.medium),
    })
    needed = ["close", "volatility", "fast_return", "medium_return", "slow_return", "slope", "ma_spread", "ema_fast", "ema_medium", "ema_slow", "adx", "perturbation"]
    df = df.dropna(subset=needed).join(ranks.select("symbol", "liquidity_rank"), "symbol", "left")
    filled = {"funding_rate": 0.0, "oi_momentum": 0.0, "spread_bps": 8.0, "depth_usd": 0.0, "liquidity_rank": 0.5}
    return df.fillna(filled).select("time", "symbol", *needed, *filled)


#: Values that differ by rounding error only are ties in a rank.
RANK_DIGITS = 9
RANKED = ("fast_return", "medium_return", "slow_return", "slope", "ma_spread", "ema_fast", "ema_medium", "ema_slow", "adx", "funding_rate", "oi_momentum")


def _mean(*xs: Column) -> Column:
    return sum(xs[1:], xs[0]) / float(len(xs))


def feature_vectors(raw: DataFrame, mode: str = "VOL_NORM_PLUS_TSTAT", slope_weight: float = 0.5, adx_threshold: float = 20.0, threshold_z: float = 1.0) -> DataFrame:
    """Trend (five modes), agreement, pullback, carry, alignment, interest, expansion, reversal risk and liquidity."""
    df = raw.withColumns({f"k_{c}": centred_rank(c, ["time"], "symbol", RANK_DIGITS) for c in RANKED}).withColumn("_neg_spread", -F.col("spread_bps"))
    df = df.withColumn("k_spread", centred_rank("_neg_spread", ["time"], "symbol", RANK_DIGITS))
    k = lambda c: F.col(f"k_{c}")
    returns, emas = _mean(k("fast_return"), k("medium_return"), k("slow_return")), _mean(k("ema_fast"), k("ema_medium"), k("ema_slow"))
    limit = max(adx_threshold, 1.0)
    support = clamp((F.col("adx") - limit) / limit, -1, 1)
    sw = min(max(slope_weight, 0.0), 1.0)
    trend = {
        "LEGACY": _mean(returns, k("ma_spread")) * (1 - sw) + k("slope") * sw + support * 0.15 + k("adx") * 0.10,
        "VOL_NORM_RETURN_STACK": returns, "REGRESSION_TSTAT": k("slope"), "EMA_RETURN_STACK": emas, "VOL_NORM_PLUS_TSTAT": returns * (1 - sw) + k("slope") * sw,
    }[mode]
    base = [k("fast_return"), k("medium_return"), k("slow_return")]
    inputs = {"LEGACY": [*base, k("slope"), k("ma_spread"), support], "VOL_NORM_RETURN_STACK": base, "REGRESSION_TSTAT": [k("slope"), *base], "EMA_RETURN_STACK": [k("ema_fast"), k("ema_medium"), k("ema_slow")], "VOL_NORM_PLUS_TSTAT": [*base, k("slope")]}[mode]
    df = df.withColumn("trend", clamp(trend, -1, 1)).withColumn("_d", F.when(F.col("trend") >= 0, 1.0).otherwise(-1.0))
    d, pos = F.col("_d"), lambda c: F.greatest(c, F.lit(0.0))
    df = df.withColumn("trend_agreement", clamp(d * _mean(*inputs), -1, 1))
    return df.select(
        "time", "symbol", "trend", "trend_agreement",
        clamp(pos(-d * F.col("perturbation")) / max(threshold_z, 0.25), 0, 1).alias("pullback"), clamp(-d * k("funding_rate"), -1, 1).alias("funding_carry"), clamp(d * k("funding_rate"), -1, 1).alias("funding_alignment"), clamp(d * k("oi_momentum"), -1, 1).alias("open_interest"),
        clamp(_mean(pos(d * k("medium_return")), pos(d * k("oi_momentum")), pos(k("adx")), pos(support)), 0, 1).alias("expansion"),
        clamp(_mean(pos(d * F.col("perturbation")), pos(d * k("funding_rate")), pos(-F.col("trend_agreement"))), 0, 1).alias("reversal_risk"),
        clamp(_mean(clamp(F.col("liquidity_rank"), 0, 1), clamp((k("spread") + 1.0) / 2.0, 0, 1)), 0, 1).alias("liquidity"),
    )


def regimes(raw: DataFrame, anchors: tuple[str, ...] = ("BTC", "ETH")) -> DataFrame:
    """One row a time: breadth, anchor trend, dispersion, score, volatility, liquidity, funding and interest."""
    df = raw.withColumns({f"k_{c}": centred_rank(c, ["time"], "symbol", RANK_DIGITS) for c in ("medium_return", "slow_return")})
    both = (F.col("k_medium_return") + F.col("k_slow_return")) / 2.0
    g = df.groupBy("time").agg(
        F.avg(both).alias("breadth"), F.avg(F.when(F.col("symbol").isin(*anchors), both)).alias("anchor_trend"), F.stddev_pop("medium_return").alias("_sd"),
        F.avg("k_medium_return").alias("_m"), F.avg("k_slow_return").alias("_s"), F.avg("volatility").alias("realized_volatility"), F.avg("liquidity_rank").alias("liquidity_score"), F.avg("funding_rate").alias("funding_pressure"), F.avg("oi_momentum").alias("open_interest_pressure"),
    )
    g = g.withColumns({"breadth": clamp(F.col("breadth"), -1, 1), "anchor_trend": clamp(F.coalesce("anchor_trend", F.lit(0.0)), -1, 1), "dispersion": F.least(F.col("_sd"), F.lit(5.0)) / 5.0})
    return g.withColumn("score", clamp((F.col("_m") + F.col("_s") + F.col("breadth") + F.col("anchor_trend")) / 4.0, -1, 1)).drop("_sd", "_m", "_s")


def market_proxy(grid: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The market's return at each time, equally or liquidity weighted."""
    r = X.with_returns(grid)
    if weights is None:
        return r.groupBy("time").agg(F.avg("r").alias("market"))
    j = r.join(weights.select("symbol", F.greatest("liquidity_rank", F.lit(1e-6)).alias("w")), "symbol").filter("r IS NOT NULL")
    return j.groupBy("time").agg((F.sum(F.col("r") * F.col("w")) / F.sum("w")).alias("market"))


def rolling_beta(grid: DataFrame, market: DataFrame, n: int, half_life: int | None = None) -> DataFrame:
    """Beta to the market over ``n`` returns (equal or exponentially fading weights), in [-3, 3], and the residual return."""
    j = X.with_returns(grid).join(market, "time")
    w = frame(["symbol"], "time", n - 1)
    full = F.count(F.when(F.col("r").isNotNull() & F.col("market").isNotNull(), 1)).over(w) == n
    if half_life is None:
        cov, var = F.covar_pop("r", "market").over(w), F.var_pop("market").over(w)
    else:
        fade = F.array(*[F.lit(0.5 ** ((n - 1 - k) / max(half_life, 1))) for k in range(n)])
        pairs = F.zip_with(F.collect_list(F.struct("r", "market")).over(w), fade, lambda p, f: F.struct(p["r"].alias("r"), p["market"].alias("m"), f.alias("f")))
        dot = lambda g: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + g(p) * p["f"])
        total = dot(lambda p: F.lit(1.0))
        mr, mm = dot(lambda p: p["r"]) / total, dot(lambda p: p["m"]) / total
        cov, var = dot(lambda p: p["r"] * p["m"]) / total - mr * mm, dot(lambda p: p["m"] * p["m"]) / total - mm * mm
    beta = F.when(full, F.when(var <= 1e-10, 0.0).otherwise(clamp(cov / var, -3, 3)))
    return j.withColumn("beta", beta).withColumn("residual", F.col("r") - F.col("beta") * F.col("market")).select("time", "symbol", "r", "market", "beta", "residual")


def future_residual(residuals: DataFrame, horizon: int) -> DataFrame:
    """The sum of the next residuals, less its median over the symbols at that time."""
    w = Window.partitionBy("symbol").orderBy("time").rowsBetween(1, horizon)
    s = residuals.withColumn("future", F.when(F.count("residual").over(w) == horizon, F.sum("residual").over(w)))
    return s.join(s.groupBy("time").agg(F.median("future").alias("_mid")), "time").withColumn("target", F.col("future") - F.col("_mid")).drop("_mid")


# ---- fits ----------------------------------------------------------------------------------------


def gram(df: DataFrame, by: list[str], xs: list[str], y: str) -> DataFrame:
    """Sums of products by key, the only data that a least-squares fit needs."""
    cols = {"one": F.lit(1.0), **{x: F.col(x) for x in xs}, y: F.col(y)}
    return df.groupBy(*by).agg(*[F.sum(cols[a] * cols[b]).alias(f"{a}__{b}") for a, b in combinations_with_replacement(cols, 2)])


def cumulative_gram(df: DataFrame, xs: list[str], y: str, gap: int) -> DataFrame:
    """At each time, the sums over all times that end ``gap`` steps before; one row a time, so the window is short."""
    g = gram(df, ["time"], xs, y)
    w = Window.orderBy("time").rowsBetween(Window.unboundedPreceding, -gap)
    return g.select("time", *[F.sum(c).over(w).alias(c) for c in g.columns if c != "time"]).dropna()


def ridge(sums: DataFrame, by: list[str], xs: list[str], y: str, penalty: float = 1.0, prior: dict[str, float] | None = None, min_n: float = 0.0, passes: int = 1) -> DataFrame:
    """Ridge with an unpenalised intercept from Gram sums; blended with a prior by n / min_n below ``min_n`` rows.

    Each further pass fits what is left of ``y``, with half the first penalty more and a step of 1 / pass. What is left
    has the sums X'y - X'X b, so no pass looks at the rows again (T7). One small solve a key, in Arrow batches.
    """
    names = ["one", *xs]
    schema = ", ".join(f"{b} {sums.schema[b].dataType.simpleString()}" for b in by) + ", n double, " + ", ".join(f"b_{n} double" for n in names) + ", r2 double"

    def run(batches):
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                get = lambda a, b: r[f"{a}__{b}"] if f"{a}__{b}" in r else r[f"{b}__{a}"]  # noqa: E731, B023
                g = np.array([[get(a, b) for b in names] for a in names], float)
                rhs = np.array([get(a, y) for a in names], float)
                solved = np.zeros(len(names))
                for k in range(passes):
                    weight = np.diag([0.0] + [penalty * (1.0 + 0.5 * k)] * len(xs))
                    solved = solved + np.linalg.lstsq(g + weight, rhs - g @ solved, rcond=None)[0] / (k + 1)
                n = g[0, 0]
                share = 1.0 if n >= min_n or not min_n else n / min_n
                blend = share * solved + (1 - share) * np.array([(prior or {}).get(k, 0.0) for k in names])
                total = get(y, y) - get("one", y) ** 2 / n if n else 0.0
                error = get(y, y) - 2 * blend @ rhs + blend @ g @ blend
                rows.append([*(r[b] for b in by), n, *blend, 1 - error / total if total > 1e-12 else 0.0])
            yield pd.DataFrame(rows, columns=[*by, "n", *(f"b_{k}" for k in names), "r2"])

    return sums.mapInPandas(run, schema)


# ---- edges and portfolios ------------------------------------------------------------------------


def edge_estimates(raw: DataFrame, vectors: DataFrame, score: Column, maker_bps: float = 1.5, taker_bps: float = 4.5, capital_usd: float = 10_000.0, turnover_bps: float = 4.0, max_weight: float = 0.08, cadence_hours: float = 24.0, quantile: float = 0.25) -> DataFrame:
    """Expected return, cost, turnover penalty, net edge, confidence and quantile bounds of each signal."""
    j = raw.join(vectors, ["time", "symbol"]).withColumn("empirical_score", score).withColumn("_neg_spread", -F.col("spread_bps"))
    j = j.withColumns({"residual_rank": centred_rank("empirical_score", ["time"], "symbol", RANK_DIGITS), "_sr": centred_rank("_neg_spread", ["time"], "symbol", RANK_DIGITS)})
    unit = lambda c: clamp(c, 0, 1)
    confidence = unit(_mean(unit(F.abs("residual_rank")), F.greatest("trend_agreement", F.lit(0.0)), unit(F.col("pullback")), unit(F.col("expansion")), unit(F.col("liquidity")), F.lit(1.0), unit((F.col("_sr") + 1.0) / 2.0)))
    j = j.withColumn("confidence", confidence)
    j = j.withColumn("expected_cost_bps", transaction_cost_bps(F.col("spread_bps"), F.col("depth_usd"), F.lit(1.0), F.col("funding_rate"), F.col("confidence"), F.col("confidence") * max_weight, maker_bps, taker_bps, capital_usd, cadence_hours))
    j = j.withColumn("turnover_penalty_bps", turnover_bps * (F.col("confidence") * max_weight) / max(max_weight, 0.01))
    j = j.withColumn("expected_net_edge_bps", F.col("empirical_score") * 10_000.0 - F.col("expected_cost_bps") - F.col("turnover_penalty_bps"))
    bounds = j.groupBy("time").agg(F.collect_list("expected_net_edge_bps").alias("_e")).select("time", floor_quantile(F.col("_e"), quantile).alias("lower_bound"), floor_quantile(F.col("_e"), 1 - quantile).alias("upper_bound"))
    out = j.join(bounds, "time")
    return out.select("time", "symbol", "empirical_score", "residual_rank", "confidence", "expected_cost_bps", "turnover_penalty_bps", "expected_net_edge_bps", "lower_bound", "upper_bound", F.when(F.col("expected_net_edge_bps") >= 0, "LONG").otherwise("SHORT").alias("direction"), "volatility", "liquidity_rank", "trend_agreement", "pullback", "expansion")


def impact_bps(weight: Column, capital_usd: float, depth_usd: Column) -> Column:
    """market impact, growing with the root of the order over the depth; 4 to 40 bps, 4 without depth."""
    return F.when(depth_usd <= 0, 4.0).otherwise(F.least(F.lit(40.0), F.sqrt(F.abs(weight) * capital_usd / depth_usd) * 10.0))


def transaction_cost_bps(spread_bps, depth_usd, book_ratio, funding, confidence, weight, maker_bps, taker_bps, capital_usd, cadence_hours) -> Column:
    """fee by maker share, half spread, impact, adverse selection and funding drift."""
    maker = F.when(confidence >= 0.80, 0.80).when(confidence >= 0.60, 0.55).otherwise(0.35)
    half = spread_bps * F.when(confidence >= 0.75, 0.35).otherwise(0.50)
    return maker_bps * maker + taker_bps * (1.0 - maker) + half + impact_bps(weight, capital_usd, depth_usd) + half * F.when(book_ratio >= 0.6, 0.08).otherwise(0.16) + F.abs(funding) * 10_000.0 * (cadence_hours / 8.0)


def eligible(edges: DataFrame, min_confidence: float = 0.2, min_agreement: float = 0.0, edge_floor_bps: float = 0.0) -> DataFrame:
    """The gates a signal passes: confidence, agreement, tail and edge floor."""
    tail = (F.col("expected_net_edge_bps") >= F.col("upper_bound")) | (F.col("expected_net_edge_bps") <= F.col("lower_bound"))
    return edges.withColumns({"gate_confidence": F.col("confidence") >= min_confidence, "gate_agreement": F.col("trend_agreement") >= min_agreement, "gate_tail": tail, "gate_edge": F.abs("expected_net_edge_bps") >= edge_floor_bps}).withColumn("eligible", F.col("gate_confidence") & F.col("gate_agreement") & F.col("gate_tail") & F.col("gate_edge"))


@dataclass(frozen=True)
class GateRules:
    """Thresholds of the entry gates. ``flat_gate`` is none, gross, edge or combined; ``flat_entry`` none, dispersion, confirmation or combined."""

    min_confidence: float = 0.2
    min_agreement: float = 0.0
    entry_edge_bps: float = 0.0
    hold_edge_bps: float = 0.0
    plateau_bps: float = 0.0
    suppression: float = 0.5  # regime score from which one direction is closed
    flat_trend: float = 0.15
    flat_breadth: float = 0.15
    flat_gate: str = "none"
    flat_edge_boost_bps: float = 0.0
    flat_entry: str = "none"
    flat_min_dispersion: float = 0.0
    flat_agreement_boost: float = 0.0


def entry_gates(signals: DataFrame, regimes: DataFrame, rules: GateRules = GateRules()) -> DataFrame:
    """The gates of each signal under its time's regime, for new entries and for what is held already.

    ``signals`` as of ``edge_estimates`` with a ``current_weight``; ``regimes`` as of ``regimes``. A position held in the
    signal's direction needs no entry style, no dispersion and no stronger agreement, and only the edge to hold.
    """
    at = regimes.select("time", F.col("score").alias("_score"), F.col("anchor_trend").alias("_trend"), F.col("breadth").alias("_breadth"), F.col("dispersion").alias("_dispersion"))
    j = signals.join(at, "time")
    long = F.col("direction") == "LONG"
    edge = F.when(long, F.col("expected_net_edge_bps")).otherwise(-F.col("expected_net_edge_bps"))
    held = F.when(long, F.col("current_weight") > 1e-9).otherwise(F.col("current_weight") < -1e-9)
    flat = (F.abs("_trend") <= min(max(rules.flat_trend, 0.0), 1.0)) & (F.abs("_breadth") <= min(max(rules.flat_breadth, 0.0), 1.0))
    checked = lambda *modes: flat & ~held & F.lit(rules.flat_entry in modes)
    raised = min(max(rules.min_agreement + rules.flat_agreement_boost, 0.0), 1.0)
    needed = F.when(checked("confirmation", "combined"), raised).otherwise(rules.min_agreement)
    boost = F.when(flat & F.lit(rules.flat_gate in ("edge", "combined")), max(rules.flat_edge_boost_bps, 0.0)).otherwise(0.0)
    bound = F.when(long, F.col("upper_bound")).otherwise(-F.col("lower_bound"))
    gates = {
        "gate_confidence": F.col("confidence") >= rules.min_confidence,
        "gate_agreement": F.col("trend_agreement") >= needed,
        "gate_style": held | (F.col("pullback") >= 1.0) | (F.col("expansion") >= 0.55) & (F.col("trend_agreement") >= max(rules.min_agreement, 0.25)),
        "gate_regime": (F.abs("_score") < min(max(rules.suppression, 0.0), 1.0)) | F.when(F.col("_score") > 0, long).when(F.col("_score") < 0, ~long).otherwise(True),
        "gate_dispersion": ~checked("dispersion", "combined") | (F.col("_dispersion") >= min(max(rules.flat_min_dispersion, 0.0), 1.0)),
        "gate_edge": edge >= F.when(held, rules.hold_edge_bps).otherwise(F.lit(rules.entry_edge_bps) + boost),
        "gate_tail": (edge + max(rules.plateau_bps, 0.0) >= bound) | held & (edge >= rules.hold_edge_bps),
    }
    out = j.withColumns(gates | {"incumbent": held}).drop("_score", "_trend", "_breadth", "_dispersion")
    return out.withColumn("eligible", reduce(lambda a, b: a & b, [F.col(g) for g in gates]))


def allocate(signals: DataFrame, quantile: float = 0.25, max_side: int = 8, gross: float = 0.5, net: float = 0.0, max_weight: float = 0.08, turnover_bps: float = 4.0, exposure: tuple[float, float] = (0.35, 1.0), equal: bool = False, long_short: bool = True) -> DataFrame:
    """Sides by sign of the score, the best by priority with an incumbent bonus, volatility-scaled or equal weights,
    capped, and dropped where the edge after turnover isn't positive. ``signals`` holds one portfolio a ``time``."""
    s = signals.withColumns({"_side": F.when(F.col("score") > 0, 1).when(F.col("score") < 0, -1), "_edge": F.abs(F.when(F.abs("expected_net_edge_bps") > 1e-9, F.col("expected_net_edge_bps")).otherwise(F.col("score")))}).filter("_side IS NOT NULL")
    if not long_short:
        s = s.filter("_side = 1")
    held = F.col("current_weight") * F.col("_side")
    keep, flip = F.when(held > 1e-9, F.col("turnover_penalty_bps")).otherwise(0.0), F.when(held < -1e-9, F.col("turnover_penalty_bps")).otherwise(0.0)
    drag = turnover_bps * F.abs("current_weight")
    s = s.withColumn("_priority", F.col("_edge") + keep - flip + drag)
    side = Window.partitionBy("time", "_side")
    s = s.withColumns({"_rank": F.row_number().over(side.orderBy(F.desc("_priority"), "symbol")), "_n": F.count("*").over(side)})
    s = s.filter(F.col("_rank") <= F.least(F.greatest(F.ceil(F.col("_n") * quantile), F.lit(1)), F.lit(max_side)))
    at = Window.partitionBy("time")
    lo, hi = exposure
    s = s.withColumn("exposure", clamp(lo + (hi - lo) * F.avg(clamp(F.col("confidence"), 0, 1)).over(at), lo, hi))
    total = F.lit(gross) * F.col("exposure")
    bias = F.greatest(-total, F.least(total, F.lit(float(net))))
    target = F.greatest((total + F.col("_side") * bias) / 2.0, F.lit(0.0)) if long_short else total
    sized = F.col("_edge") + F.when(held > 1e-9, F.col("turnover_penalty_bps") + drag).otherwise(0.0)
    raw = F.lit(1.0) if equal else F.greatest(sized, F.lit(0.05)) * clamp(F.col("confidence"), 0, 1) * clamp(F.col("liquidity"), 0.1, 1) / F.greatest("volatility", F.lit(1e-4))
    s = s.withColumn("_raw", raw)
    s = s.withColumn("_share", F.col("_raw") / F.greatest(F.sum("_raw").over(side), F.lit(1e-4)))
    s = s.withColumn("weight", F.least(target * F.col("_share"), F.lit(max_weight)))
    s = s.withColumn("turnover", F.abs(F.col("weight") * F.col("_side") - F.col("current_weight")))
    paid = F.when(F.col("turnover") <= 1e-9, 0.0).otherwise(turnover_bps * F.col("turnover") / max(max_weight, 0.01))
    s = s.withColumn("adjusted_edge_bps", F.col("_edge") - (paid - F.col("turnover_penalty_bps"))).filter("adjusted_edge_bps > 0")
    return s.select("time", "symbol", F.when(F.col("_side") == 1, "LONG").otherwise("SHORT").alias("direction"), "weight", "turnover", "adjusted_edge_bps", "exposure")


def leaderboard(configs: DataFrame, order: list[Column]) -> DataFrame:
    """Configurations by the given keys, with their rank. There is one row a configuration, so one task sorts few rows."""
    return configs.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def calibrate(candidates: DataFrame, thresholds: list[float], least: int) -> DataFrame:
    """For each threshold the accepted candidates, their median edge and drawdown, feasibility, and the best."""
    grid = candidates.select(F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"), "edge", "drawdown")
    ok = F.col("edge") >= F.col("threshold")
    g = grid.groupBy("threshold").agg(F.count_if(ok).alias("accepted"), F.median(F.when(ok, F.col("edge"))).alias("median_edge"), F.median(F.when(ok, F.col("drawdown"))).alias("median_drawdown"))
    g = g.withColumn("feasible", F.col("accepted") >= least)
    best = F.row_number().over(Window.orderBy(F.desc("feasible"), F.desc("median_edge"), "threshold")) == 1
    return g.withColumn("best", best & F.col("feasible"))


def sleeve_correlation(returns: DataFrame, n_steps: int = 32) -> DataFrame:
    """Average pairwise correlation of the sleeves and the share of their first component, by key.

    Pair sums are formed in Spark; the power iteration runs on one small matrix a key.
    """
    a, b = returns.alias("a"), returns.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.time") == F.col("b.time")) & (F.col("a.sleeve") <= F.col("b.sleeve")))
    cov = pairs.groupBy(F.col("a.key").alias("key"), F.col("a.sleeve").alias("x"), F.col("b.sleeve").alias("y")).agg(F.covar_pop("a.r", "b.r").alias("cov"), F.corr("a.r", "b.r").alias("corr"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf.x) | set(pdf.y))
        at = {n: i for i, n in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        for x, y, c in zip(pdf.x, pdf.y, pdf["cov"]):
            m[at[x], at[y]] = m[at[y], at[x]] = c
        v = np.ones(len(names)) / np.sqrt(len(names))
        for _ in range(n_steps):
            u = m @ v
            v = u / max(np.linalg.norm(u), 1e-12)
        off = pdf[pdf.x != pdf.y]["corr"].dropna()
        return pd.DataFrame({"key": [pdf.key.iloc[0]], "avg_correlation": [off.mean() if len(off) else 0.0], "first_share": [float(v @ m @ v / max(np.trace(m), 1e-12))]})

    return cov.groupBy("key").applyInPandas(run, f"key {returns.schema['key'].dataType.simpleString()}, avg_correlation double, first_share double")


# ---- scales --------------------------------------------------------------------------------------


def participation_weight(strength: Column, threshold: float) -> Column:
    """0 below the threshold, then linear to 1 at full strength."""
    return F.when(strength < threshold, 0.0).otherwise(clamp((strength - threshold) / max(1.0 - threshold, 1e-9), 0, 1))


def gross_net_targets(regimes_df: DataFrame, gross: float = 0.5, scale: float = 1.0, threshold: float = 0.15, bias: float = 0.5, flat_threshold: float = 0.15, flat_scale: float = 0.5, hazard_floor: float = 0.4) -> DataFrame:
    """Gross target after the flat-regime throttle and the trend hazard, and the net target of the regime bias."""
    trend, breadth = F.col("anchor_trend"), F.col("breadth")
    flat = (F.abs(trend) < flat_threshold) & (F.abs(breadth) < flat_threshold)
    hazard = clamp(1.0 - F.abs(trend) / max(flat_threshold, 1e-9), 0, 1)
    total = gross * min(max(scale, 0.05), 1.0) * F.when(flat, min(max(flat_scale, 0.05), 1.0)).otherwise(1.0) * clamp(1.0 - hazard * (1.0 - hazard_floor), hazard_floor, 1.0)
    out = regimes_df.withColumns({"flat_regime": flat, "hazard": hazard, "gross_target": total})
    return out.withColumn("net_target", F.col("gross_target") * clamp(F.col("score"), -1, 1) * participation_weight(F.abs("score"), threshold) * min(max(bias, 0.0), 1.0))


def compression_scale(z: Column, strength: float = 0.5, threshold: float = 1.0) -> Column:
    """Gross scale that falls by a logistic of the compression z-score, at least 0.05."""
    return clamp(1.0 - strength / (1.0 + F.exp(-(z - threshold))), 0.05, 1.0)


def robust_z(df: DataFrame, value: str, by: list[str], order: str, back: int = 30) -> DataFrame:
    """Distance to the median of the preceding rows in scaled median deviations (frames are bounded)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-back, -1)
    history = F.array_sort(F.collect_list(value).over(w))
    mid = lambda a: (F.element_at(a, F.floor((F.size(a) + 1) / 2).cast("int")) + F.element_at(a, F.ceil((F.size(a) + 1) / 2).cast("int"))) / 2.0
    df = df.withColumn("_h", history).withColumn("_m", F.when(F.size("_h") > 1, mid(F.col("_h"))))
    df = df.withColumn("_d", F.array_sort(F.transform("_h", lambda x: F.abs(x - F.col("_m")))))
    spread = 1.4826 * F.when(F.size("_d") > 1, mid(F.col("_d")))
    return df.withColumn("z", F.when(spread > 1e-9, (F.col(value) - F.col("_m")) / spread)).drop("_h", "_m", "_d")
