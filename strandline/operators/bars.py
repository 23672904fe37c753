"""Bars: one-minute staging, five-minute execution context, daily panel, re-bucketing and universes.

Every aggregation is keyed by (bucket, symbol, exchange) and combines on the map side, so a hot symbol spreads over its
buckets. Floating sums are left to the caller to round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.columns import bucket, safe_divide
from strandline.sources.tables import KEYS

BOOK = ["best_bid", "best_ask", "spread", "spread_pct", "mid_price", "bid_depth_10", "ask_depth_10"]


def minute_trades(trades: DataFrame, width: str = "1 minute") -> DataFrame:
    """A1: volumes by side, count, notional and last event of each bucket."""
    by_side = lambda side: F.sum(F.when(F.col("side") == side, F.col("size")).otherwise(0.0))
    return trades.groupBy(bucket("time", width).alias("time"), "symbol", "exchange").agg(
        F.sum("size").alias("trade_volume"), by_side("buy").alias("buy_volume"), by_side("sell").alias("sell_volume"),
        F.count("*").alias("trade_count"), F.sum(F.col("price") * F.col("size")).alias("trade_notional"), F.max("time").alias("last_event_time"),
    )


def minute_books(books: DataFrame, width: str = "1 minute") -> DataFrame:
    """A2: the metrics of the bucket's latest book and the number of books."""
    state = F.max_by(F.struct(*BOOK), "time")
    out = books.groupBy(bucket("time", width).alias("time"), "symbol", "exchange").agg(state.alias("s"), F.count("*").alias("orderbook_samples"), F.max("time").alias("last_event_time"))
    return out.select(*KEYS, "s.*", "orderbook_samples", "last_event_time")


def minute_context(context: DataFrame, width: str = "1 minute") -> DataFrame:
    """A3: last known funding rate and open interest of the bucket, each over the rows that hold one."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("time")))
    return context.groupBy(bucket("time", width).alias("time"), "symbol", "exchange").agg(last("funding_rate").alias("funding_rate"), last("open_interest").alias("open_interest"), F.max("time").alias("last_event_time"))


def candles(trades: DataFrame, width: str) -> DataFrame:
    """OHLCV of trades by bucket, first and last by time."""
    return trades.groupBy(bucket("time", width).alias("time"), "symbol", "exchange").agg(
        F.min_by("price", "time").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "time").alias("close"),
        F.sum("size").alias("volume"), F.count("*").alias("num_trades"),
    )


def finality(df: DataFrame, as_of: Column, width: str, lag_minutes: int) -> DataFrame:
    """ST2 in batch: due time, and whether a bar is provisional or final at ``as_of``."""
    due = F.col("time") + F.expr(f"INTERVAL {width}") + F.expr(f"INTERVAL {lag_minutes} MINUTES")
    final = due <= as_of
    return df.withColumns({"is_provisional": ~final, "is_finalized": final, "finalization_due_at": due, "finalized_at": F.when(final, as_of)})


def bars_5m(candles_5m: DataFrame, trades_1m: DataFrame, books_1m: DataFrame, context_1m: DataFrame, as_of: Column, lag_minutes: int = 3) -> DataFrame:
    """The execution context of every bucket that has a candle, a trade or a book."""
    by = [bucket("time", "5 minutes").alias("time"), "symbol", "exchange"]
    t = trades_1m.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("trade_volume", "buy_volume", "sell_volume", "trade_count", "trade_notional")])
    t = t.withColumn("trade_vwap", F.when(F.col("trade_volume") > 0, F.col("trade_notional") / F.col("trade_volume"))).drop("trade_notional")
    o = books_1m.groupBy(*by).agg(*[F.avg(c).alias(c) for c in BOOK], F.sum("orderbook_samples").alias("orderbook_samples"))
    a = context_1m.groupBy(*by).agg(F.avg("funding_rate").alias("funding_rate"), F.avg("open_interest").alias("open_interest"), F.count("*").alias("context_samples"))
    c = candles_5m.select(*KEYS, "open", "high", "low", "close", "volume", "num_trades")
    # Each part holds a key once, so one grouped pass over their union joins them; a bucket needs a candle, a trade or a book.
    parts = [df.withColumn(flag, F.lit(True)) for df, flag in ((c, "_c"), (t, "_t"), (o, "_o"), (a, "_a"))]
    both = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    j = both.groupBy(*KEYS).agg(*[F.max(x).alias(x) for x in both.columns if x not in KEYS]).filter("_c OR _t OR _o")
    price = lambda name: F.coalesce(F.col(name), F.col("trade_vwap"), F.nullif("mid_price", F.lit(0.0)), F.col("best_bid"), F.col("best_ask"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    out = j.select(
        *KEYS, *[price(x).alias(x) for x in ("open", "high", "low", "close")],
        F.coalesce("volume", "trade_volume", F.lit(0.0)).alias("volume"), F.coalesce("num_trades", "trade_count", F.lit(0)).alias("num_trades"),
        zero("trade_volume").alias("trade_volume"), zero("buy_volume").alias("buy_volume"), zero("sell_volume").alias("sell_volume"),
        F.coalesce("trade_count", F.lit(0)).alias("trade_count"), "trade_vwap", "best_bid", "best_ask", "spread", "spread_pct",
        F.coalesce(F.nullif("mid_price", F.lit(0.0)), F.col("close")).alias("mid_price"), zero("bid_depth_10").alias("bid_depth_10"), zero("ask_depth_10").alias("ask_depth_10"),
        F.coalesce("orderbook_samples", F.lit(0)).alias("orderbook_samples"), "funding_rate", "open_interest",
        F.col("_c").isNotNull().alias("candle_observed"), F.col("_t").isNotNull().alias("trade_observed"), F.col("_o").isNotNull().alias("orderbook_observed"),
        (F.coalesce("context_samples", F.lit(0)) > 0).alias("asset_context_observed"),
    )
    return finality(out, as_of, "5 MINUTES", lag_minutes)


def panel_daily(candles_4h: DataFrame, execution: DataFrame, funding: DataFrame, interest: DataFrame, as_of: Column, lag_minutes: int = 3, spread_scale: float = 10_000.0) -> DataFrame:
    """The daily signal panel, driven by the candles."""
    by = [bucket("time", "1 day").alias("time"), "symbol", "exchange"]
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("time"))
    c = candles_4h.groupBy(*by).agg(
        F.min_by("open", at("open")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at("close")).alias("close"),
        F.sum(F.coalesce("volume", F.lit(0.0))).alias("volume"), F.sum(F.coalesce("num_trades", F.lit(0))).alias("num_trades"), F.count("*").alias("candle_bars"),
    )
    total = lambda name: F.sum(F.coalesce(F.col(name), F.lit(0.0)))
    share = lambda flag: F.avg(F.when(F.col(flag), 1.0).otherwise(0.0))
    e = execution.groupBy(*by).agg(
        total("trade_volume").alias("trade_volume"), total("buy_volume").alias("buy_volume"), total("sell_volume").alias("sell_volume"), F.sum("trade_count").alias("trade_count"),
        # The numerator takes a missing price as 0 while its volume stays below.
        F.when(total("trade_volume") > 0, F.sum(F.coalesce("trade_vwap", F.lit(0.0)) * F.coalesce("trade_volume", F.lit(0.0))) / total("trade_volume")).alias("trade_vwap"),
        F.avg(F.when(F.col("spread_pct") > 0, F.col("spread_pct") * spread_scale)).alias("spread_bps"),
        F.avg((F.coalesce("bid_depth_10", F.lit(0.0)) + F.coalesce("ask_depth_10", F.lit(0.0))) / 2.0 * F.col("mid_price")).alias("depth_usd"),
        F.avg("funding_rate").alias("e_funding"), F.avg("open_interest").alias("e_interest"),
        *[share(f"{x}_observed").alias(f"{x}_observed_ratio") for x in ("trade", "orderbook", "asset_context")],
        *[F.count_if(F.col(f"{x}_observed")).alias(f"{x}_bars") for x in ("trade", "orderbook", "asset_context")],
    )
    f = funding.groupBy(*by).agg(F.avg("funding_rate").alias("funding_rate"))
    i = interest.groupBy(*by).agg(F.avg("open_interest").alias("open_interest"))
    j = c.join(e, KEYS, "left").join(f, KEYS, "left").join(i, KEYS, "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0.0)).alias(name)
    out = j.select(
        *KEYS, "open", "high", "low", "close", "volume", "num_trades", zero("trade_volume"), zero("buy_volume"), zero("sell_volume"),
        F.coalesce("trade_count", F.lit(0)).alias("trade_count"), "trade_vwap", "spread_bps", "depth_usd",
        F.coalesce("funding_rate", "e_funding").alias("funding_rate"), F.coalesce("open_interest", "e_interest").alias("open_interest"),
        *[zero(f"{x}_observed_ratio") for x in ("trade", "orderbook", "asset_context")], (F.col("candle_bars") * 240).alias("candle_minutes"),
        *[(F.coalesce(f"{x}_bars", F.lit(0)) * 5).alias(f"{x}_minutes") for x in ("trade", "orderbook", "asset_context")],
    )
    return finality(out, as_of, "1 DAY", lag_minutes)


def rebucket(bars: DataFrame, bar_minutes: int) -> DataFrame:
    """A10: finalised bars at any width that divides a day."""
    done = bars.filter("is_finalized")
    return done.groupBy(bucket("time", f"{bar_minutes} minutes").alias("time"), "symbol", "exchange").agg(
        F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume"),
        F.avg("spread").alias("spread"), F.avg("funding_rate").alias("funding_rate"), F.avg("open_interest").alias("open_interest"), F.count("*").alias("bars"),
    )


def carry(context: DataFrame, width: str) -> DataFrame:
    """Average funding and open interest of a bucket, each over the rows that hold one."""
    return context.groupBy(bucket("time", width).alias("time"), "symbol").agg(F.avg("funding_rate").alias("funding_rate"), F.avg("open_interest").alias("open_interest"))


def liquid_universe(bars: DataFrame, top: int, since: Column | None = None) -> DataFrame:
    """Symbols by average notional (ties by symbol), the first ``top`` of them, or all for ``top`` <= 0."""
    seen = bars if since is None else bars.filter(F.col("time") >= since)
    ranked = seen.groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("notional")).orderBy(F.desc("notional"), "symbol")
    return ranked.limit(top) if top > 0 else ranked


def keep_symbols(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows of the chosen symbols; Spark broadcasts the universe when it is small."""
    return bars.join(universe.select("symbol"), "symbol", "left_semi")


def volume_stats(trades: DataFrame) -> DataFrame:
    """Totals, sides and shares of the trades of each symbol."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("size")).otherwise(0.0))
    out = trades.groupBy("symbol").agg(F.count("*").alias("trade_count"), F.sum("size").alias("total_volume"), side("buy").alias("buy_volume"), side("sell").alias("sell_volume"), F.avg("price").alias("avg_price"))
    return out.withColumns({f"{s}_pct": safe_divide(F.col(f"{s}_volume") * 100.0, F.col("total_volume"), 0.0) for s in ("buy", "sell")})


def bucket_series(df: DataFrame, time: str, width: str, by: list[str], **aggs: Column) -> DataFrame:
    """Named aggregates by time bucket and keys."""
    return df.groupBy(bucket(time, width).alias("bucket"), *by).agg(*[c.alias(n) for n, c in aggs.items()])
