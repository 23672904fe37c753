"""Costs, execution and risk: reports, baselines, fills, position sizes, stops, checks and child orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.columns import clamp, safe_divide
from strandline.operators.ordering import floor_quantiles

# ---- reports -------------------------------------------------------------------------------------


def cost_report(costs: DataFrame) -> DataFrame:
    """Average costs by strategy, exchange, side and fee tier."""
    return costs.groupBy("strategy_name", "exchange", "side", "fee_tier").agg(F.count("*").alias("rows"), *[F.avg(c).alias(f"avg_{c}") for c in ("slippage_bps", "fee_bps", "total_cost_bps")])


def execution_baseline(costs: DataFrame, runs: DataFrame) -> DataFrame:
    """Average cost and fill ratio (a JSON number, unreadable ones skipped) by strategy, and the edge per trade of its latest run."""
    fill = F.expr("try_cast(get_json_object(metadata, '$.fillRatio') AS DOUBLE)")
    base = costs.groupBy("strategy_name").agg(F.avg("total_cost_bps").alias("avg_total_cost_bps"), F.avg("slippage_bps").alias("avg_slippage_bps"), F.avg(fill).alias("avg_fill_ratio"))
    edge = F.when(F.col("trades") > 0, F.col("net_return_pct") * 100.0 / F.col("trades"))
    latest = runs.groupBy("strategy_name").agg(F.max_by(edge, F.struct("run_at", "run_id")).alias("backtest_edge_bps"))
    return base.join(latest, "strategy_name", "full_outer")


def monthly_runs(runs: DataFrame) -> DataFrame:
    """Runs by month: number, mean, median, worst drawdown."""
    return runs.groupBy(F.date_trunc("month", "run_at").alias("month")).agg(F.count("*").alias("runs"), F.avg("net_return_pct").alias("avg_return_pct"), F.median("net_return_pct").alias("median_return_pct"), F.max("max_drawdown_pct").alias("worst_drawdown_pct"))


def walk_forward_seed(runs: DataFrame, newest: int = 40) -> DataFrame:
    """Span and averages of each (strategy, symbol); the newest ``newest`` (a report)."""
    g = runs.groupBy("strategy_name", "symbol").agg(F.min("run_at").alias("start"), F.max("run_at").alias("end"), F.count("*").alias("runs"), F.avg("net_return_pct").alias("avg_return_pct"))
    return g.orderBy(F.desc("end"), "strategy_name", "symbol").limit(newest)


def fills_summary(fills: DataFrame, by: list[str], floor: float = 0.85, slip_bps: float = 8.0, latency_ms: int = 1500) -> DataFrame:
    """Fill ratio, slippage by direction, fee, p50 and p95 latency by floor index (T4), and alerts."""
    raw = F.when(F.col("direction") == "LONG", F.col("executed_price") / F.col("expected_price") - 1.0).otherwise(F.col("expected_price") / F.col("executed_price") - 1.0) * 10_000.0
    g = fills.groupBy(*by).agg((F.sum(F.abs("filled")) / F.greatest(F.sum(F.abs("planned")), F.lit(1e-4))).alias("fill_ratio"), F.avg(raw).alias("avg_slippage_bps"), F.avg("fee_bps").alias("fee_bps"))
    latency = floor_quantiles(fills, by, "latency_ms", {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95})
    g = g.withColumn("_key", F.struct(*by)).join(latency, "_key", "left").drop("_key")
    return g.withColumn("alerts", F.array_compact(F.array(F.when(F.col("fill_ratio") < floor, F.lit("fill_ratio")), F.when(F.col("avg_slippage_bps") > slip_bps, F.lit("slippage")), F.when(F.col("latency_p95_ms") > latency_ms, F.lit("latency")))))


def universe_breakdown(symbols: DataFrame) -> DataFrame:
    """The universe counted by kind, as rows."""
    g = symbols.agg(F.count_if(F.col("coverage_ratio") >= 0.98).alias("deep"), F.count_if(F.col("coverage_ratio").between(0.5, 0.98)).alias("core"), F.count_if("active_recent").alias("tradable"), F.count_if(F.col("coverage_ratio") < 0.5).alias("fragile"))
    return g.unpivot([], ["deep", "core", "tradable", "fragile"], "kind", "symbols")


def forward_costs(df: DataFrame, notional_usd: float = 1000.0, maker_bps: float = 1.5, taker_bps: float = 4.5, minutes: int = 15, recent_return: Column | None = None) -> DataFrame:
    """seven cost components in bps, edge after cost, fill ratio and dollars. Needs spread_pct, ret, depth, mid_price, micro_alpha, funding_rate.

    ``recent_return`` is the mean of the last ten returns (null: not known yet), from which the basis drifts.
    """
    spread = F.greatest("spread_pct", F.lit(0.0)) * 100.0
    alpha = F.abs("micro_alpha")
    depth = F.col("depth") * F.col("mid_price")
    parts = {
        "fee_bps": F.when(alpha > 0.35, taker_bps).otherwise(maker_bps), "spread_cost_bps": spread, "slippage_bps": clamp(1.5 + spread * 0.25 + F.abs("ret") * 7000.0, 0.2, 30.0),
        "impact_bps": clamp(F.coalesce(0.6 + safe_divide(F.lit(notional_usd), depth) * 12.0, F.lit(2.0)), 0.3, 18.0), "adverse_selection_bps": clamp(0.8 + alpha * 3.5, 0.4, 8.0),
        "funding_drift_bps": clamp(-F.coalesce("funding_rate", F.lit(0.0)) * 10_000.0 * minutes / 60.0, -5.0, 5.0),
        "basis_drift_bps": clamp(F.coalesce(F.lit(None).cast("double") if recent_return is None else recent_return, F.lit(0.0)) * 1_000.0, -5.0, 5.0),
    }
    out = df.withColumns(parts)
    total = sum((F.col(c) for c in list(parts)[1:]), F.col("fee_bps"))
    edge = clamp(F.col("micro_alpha") * 10.0, -25.0, 25.0)
    return out.withColumn("total_cost_bps", total).withColumns({"edge_after_cost_bps": edge - F.col("total_cost_bps"), "fill_ratio": clamp(0.92 - spread / 200.0 - alpha * 0.08, 0.35, 1.0), "estimated_fee_usd": notional_usd * F.abs("fee_bps") / 10_000.0, "estimated_cost_usd": notional_usd * F.abs("total_cost_bps") / 10_000.0})


# ---- risk ----------------------------------------------------------------------------------------


def position_size(df: DataFrame, max_percent: float = 20.0, least: float = 0.0) -> DataFrame:
    """size by ``method`` (fixed, percent, kelly, atr, volatility), capped, floored, cut to eight decimals. Doubles."""
    by_price = lambda value: value / F.col("entry_price")
    b = F.col("avg_win") / F.col("avg_loss")
    kelly = (b * F.col("win_rate") - (1.0 - F.col("win_rate"))) / b * F.col("kelly_fraction")
    raw = (
        F.when(F.col("method") == "fixed", F.col("fixed_size")).when(F.col("method") == "percent", by_price(F.col("equity") * F.col("percent") / 100.0)).when(F.col("method") == "kelly", by_price(F.col("equity") * kelly))
        .when(F.col("method") == "atr", F.col("equity") * F.col("percent") / 100.0 / (F.col("atr") * F.col("atr_multiple"))).when(F.col("method") == "volatility", by_price(F.col("equity") * F.col("percent") / 100.0))
    )
    capped = F.greatest(F.least(raw, by_price(F.col("equity") * max_percent / 100.0)), F.lit(least))
    return df.withColumn("size", F.floor(capped * 1e8) / 1e8)


def stop_price(entry: Column, side: Column, distance: Column) -> Column:
    """F24."""
    return F.when(side == "long", entry - distance).otherwise(entry + distance)


def targets(entry: Column, stop: Column, side: Column, ladder: list[tuple[float, float]]) -> Column:
    """array of (price, size_percent) at multiples of the risk."""
    risk = F.abs(entry - stop)
    at = lambda m: F.when(side == "long", entry + risk * m).otherwise(entry - risk * m)
    return F.array(*[F.struct(at(m).alias("price"), F.lit(float(p)).alias("size_percent")) for m, p in ladder])


def check_position(df: DataFrame, max_open: int, max_percent: float) -> DataFrame:
    """number and size limits; the first that is broken is the reason."""
    reason = F.when(F.col("open_positions") >= max_open, "max_positions").when(F.col("position_value") / F.col("equity") * 100.0 > max_percent, "size_limit")
    return df.withColumn("reason", reason).withColumn("approved", F.col("reason").isNull())


def child_orders(targets_df: DataFrame, step: float = 0.02, window_minutes: int = 120, spread_bps: float = 4.0, impact_bps: float = 3.0, maker_bps: float = 1.5, taker_bps: float = 4.5) -> DataFrame:
    """style by confidence, one slice a step of weight, rising or equal sizes, trigger minutes and expected costs."""
    c = clamp(F.col("confidence"), 0, 1)
    style = F.when((c >= 0.80) & F.lit(spread_bps <= 6.0), "MAKER_RAMP").when((c >= 0.60) & F.lit(impact_bps <= 5.0), "TWAP").when(c >= 0.40, "POV").otherwise("VWAP_TRACK")
    maker = F.create_map(*[F.lit(x) for kv in {"MAKER_RAMP": 0.8, "TWAP": 0.5, "POV": 0.35, "VWAP_TRACK": 0.4}.items() for x in kv])
    n = F.col("slices")
    out = targets_df.withColumns({"style": style, "slices": F.greatest(F.ceil(F.abs("weight") / step), F.lit(1)).cast("int")}).withColumn("sequence", F.explode(F.sequence(F.lit(1), n)))
    share = F.when(F.col("style") == "MAKER_RAMP", F.col("sequence") / (n * (n + 1) / 2.0)).otherwise(1.0 / n)
    m = maker[F.col("style")]
    return out.withColumns({
        "child_weight": F.abs("weight") * share, "maker_share": m, "expected_fee_bps": maker_bps * m + taker_bps * (1.0 - m), "expected_spread_bps": spread_bps * F.when(F.col("style") == "MAKER_RAMP", 0.35).otherwise(0.5),
        "expected_impact_bps": impact_bps / n, "trigger_minutes": F.floor(window_minutes * (F.col("sequence") - 1) / n).cast("int"),
    })


def plan_cost(children: DataFrame, by: list[str]) -> DataFrame:
    """Weight-averaged cost and mean maker share of a plan's child orders."""
    cost = F.col("expected_fee_bps") + F.col("expected_spread_bps") + F.col("expected_impact_bps")
    return children.groupBy(*by).agg((F.sum(F.col("child_weight") * cost) / F.greatest(F.sum("child_weight"), F.lit(1e-4))).alias("estimated_cost_bps"), F.avg("maker_share").alias("estimated_maker_share"), F.count("*").alias("child_orders"))
