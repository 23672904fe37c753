"""Universes and small relational reads: filters with sentinels, ordered merges, repair predicates, public projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.ordering import positions


def universe(symbols: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """P5: listed symbols, upper-cased and distinct; an empty include list keeps all."""
    s = symbols.filter(~F.coalesce("delisted", F.lit(False))).select(F.upper(F.trim("symbol")).alias("symbol")).filter("symbol <> ''").distinct()
    if include:
        s = s.filter(F.col("symbol").isin(*[x.strip().upper() for x in include]))
    return s.filter(~F.col("symbol").isin(*[x.strip().upper() for x in exclude])) if exclude else s


def choose(df: DataFrame, every: str = "all", **wanted: str) -> DataFrame:
    """Equality on each parameter that isn't the sentinel."""
    for name, value in wanted.items():
        if value != every:
            df = df.filter(F.col(name) == value)
    return df


def aliases(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows of an exchange under any of its names."""
    return df.filter(F.col("exchange").isin(*names))


def public_rows(rows: DataFrame, columns: list[str], visible: Column, deleted: str | None = None, archived: str | None = None) -> DataFrame:
    """A read-only projection of visible rows that are neither deleted nor archived."""
    out = rows.filter(visible)
    if deleted:
        out = out.filter(F.col(deleted).isNull())
    if archived:
        out = out.filter(~F.coalesce(archived, F.lit(False)))
    return out.select(*columns)


def list_counts(cards: DataFrame, key: str, archived: str) -> DataFrame:
    """Live cards of each list."""
    return cards.filter(~F.coalesce(archived, F.lit(False))).groupBy(key).agg(F.count("*").alias("card_count"))


def ordered_merge(priority: DataFrame, rest: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys, the priority list first, each part in its own order (a number or a timestamp)."""
    u = priority.select(key, order, F.lit(0).alias("_p")).union(rest.select(key, order, F.lit(1).alias("_p")))
    first = u.groupBy(key).agg(F.min(F.struct("_p", F.col(order).alias("_o"))).alias("_m")).select(key, "_m.*")
    return positions(first, "_p", "_o", key).select(key, "position")


def distinct_candidates(df: DataFrame) -> DataFrame:
    """U4: one candidate a (symbol, interval, start)."""
    return df.dropDuplicates(["symbol", "interval", "start"])


def repair_order(states: DataFrame) -> list[Column]:
    """L3: no candle first, then by the newest other activity, then by symbol."""
    return [F.asc_nulls_first("candle_5m_latest_raw_time"), F.desc_nulls_last(F.greatest("trade_latest_raw_time", "orderbook_l2_latest_raw_time", "funding_latest_raw_time")), F.asc("symbol")]


def needs_repair(states: DataFrame, activity_cutoff: Column, stale_cutoff: Column) -> DataFrame:
    """Q9: whether a symbol's candles must be repaired: recent activity, and candles behind it or stale (none: trades must be recent)."""
    activity = F.greatest("trade_latest_raw_time", "orderbook_l2_latest_raw_time", "funding_latest_raw_time", "open_interest_latest_raw_time")
    recent = F.coalesce(activity >= activity_cutoff, F.lit(False))
    candle, trade = F.col("candle_5m_latest_raw_time"), F.col("trade_latest_raw_time")
    behind = F.when(candle.isNull(), F.coalesce(trade >= activity_cutoff, F.lit(False))).otherwise((candle < F.date_trunc("minute", activity)) | (candle < stale_cutoff))
    return states.withColumn("repair", recent & behind)


def daily_market(bars: DataFrame) -> DataFrame:
    """Mean return, its deviation and the range over the minimum, by day and symbol."""
    prev = F.lag("close").over(Window.partitionBy("symbol").orderBy("time"))
    r = F.when(prev.isNull() | (prev == 0), 0.0).otherwise((F.col("close") - prev) / prev)
    return bars.withColumn("_r", r).groupBy(F.date_trunc("day", "time").alias("day"), "symbol").agg(F.avg("_r").alias("avg_ret"), F.stddev_samp("_r").alias("vol"), (F.max("close") - F.min("close")).alias("_w"), F.min("close").alias("_l")).select("day", "symbol", "avg_ret", "vol", F.when(F.col("_l") != 0, F.col("_w") / F.col("_l")).alias("intraday_range"))


def quality_report(bars: DataFrame, books: DataFrame) -> DataFrame:
    """Bars, last bar, share of bars whose high is below the low, average spread and last book of each symbol."""
    c = bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.max("time").alias("last_bar"), F.avg(F.when(F.col("high") < F.col("low"), 1.0).otherwise(0.0)).alias("invalid_ohlc_ratio"))
    return c.join(books.groupBy("symbol").agg(F.avg("spread_pct").alias("avg_spread_pct"), F.max("time").alias("last_book")), "symbol", "left")


def daily_merge(runs: DataFrame, market: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Runs by day with the day's market and sentiment; zero where there is none."""
    m = market.groupBy("day").agg(F.avg("avg_ret").alias("mkt_ret"), F.avg("vol").alias("mkt_vol"), F.avg("intraday_range").alias("mkt_range"))
    s = sentiment.groupBy(F.date_trunc("day", "observed_at").alias("day")).agg(F.avg("sentiment_score").alias("sent"), F.avg("confidence").alias("sent_conf"), F.count("*").cast("double").alias("sent_n"))
    j = runs.withColumn("day", F.date_trunc("day", "run_at")).join(m, "day", "left").join(s, "day", "left")
    return j.fillna(0.0, ["mkt_ret", "mkt_vol", "mkt_range", "sent", "sent_conf", "sent_n"])
