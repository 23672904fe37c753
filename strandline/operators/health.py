"""Data health: symbol and exchange views, status evaluation, issue list, summary, venue sanity, rule checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.columns import bucket_seconds, lag_seconds
from strandline.operators.state import coverage_state, materialisation_state

CHANNELS = ("candle_5m", "trade", "orderbook_l2", "funding", "open_interest")


def channel_pivot(sync: DataFrame) -> DataFrame:
    """Latest time and row count of each channel, side by side."""
    of = lambda c: F.col("channel") == c
    return sync.groupBy("exchange", "symbol").agg(
        *[F.max(F.when(of(c), F.col("latest_raw_time"))).alias(f"{c}_latest_raw_time") for c in CHANNELS],
        *[F.sum(F.when(of(c), F.col("row_count"))).alias(f"{c}_row_count") for c in CHANNELS],
    )


def recent_counts(bars: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Rows, observed rows by kind and final rows of the last hours."""
    new = F.col("time") >= as_of - F.expr(f"INTERVAL {hours} HOURS")
    usable = F.col("orderbook_observed") & (F.coalesce("spread", F.lit(0.0)) > 0) & ((F.coalesce("bid_depth_10", F.lit(0.0)) > 0) | (F.coalesce("ask_depth_10", F.lit(0.0)) > 0))
    kinds = {"feature_rows": F.lit(True), "candle_observed_rows": F.col("candle_observed"), "trade_observed_rows": F.col("trade_observed"), "orderbook_observed_rows": F.col("orderbook_observed"), "execution_observed_rows": usable, "finalized_rows": F.col("is_finalized")}
    return bars.groupBy("exchange", "symbol").agg(*[F.count_if(new & c).alias(f"recent_{n}_24h") for n, c in kinds.items()])


def symbol_health(sync: DataFrame, bars: DataFrame, as_of: Column, bar_minutes: int = 5, active_hours: int = 6) -> DataFrame:
    """Q1: one row a symbol of the union of all state tables; ``bar_minutes=1`` gives the legacy expectation."""
    coverage = coverage_state(sync.filter("channel = 'candle_5m'"), bars, 5).select("exchange", "symbol", F.col("earliest_raw_time").alias("_earliest"), F.col("coverage_ratio").alias("historical_coverage_ratio"), F.col("expected_bars").alias("historical_expected_bars"))
    state = materialisation_state(bars).select("exchange", "symbol", "latest_feature_time", "finalized_through")
    keys = ["exchange", "symbol"]
    universe = sync.select(*keys).union(bars.select(*keys)).distinct()
    j = universe.join(channel_pivot(sync), keys, "left").join(state, keys, "left").join(coverage, keys, "left").join(recent_counts(bars, as_of), keys, "left")
    at = lambda c: bucket_seconds(c, bar_minutes)
    j = j.withColumns({"_from": F.coalesce("_earliest", "candle_5m_latest_raw_time"), "_day": as_of - F.expr("INTERVAL 24 HOURS")}).withColumns({"_a": at("_from"), "_b": at("_day"), "_z": at("candle_5m_latest_raw_time")})
    expected = F.when(F.col("_z").isNull(), 0).otherwise(F.greatest(((F.col("_z") - F.greatest("_a", "_b")) / (bar_minutes * 60)).cast("long") + 1, F.lit(0)))
    rows = [c for c in j.columns if c.startswith("recent_") or c.endswith("_row_count") or c == "historical_expected_bars"]
    j = j.withColumns({c: F.coalesce(c, F.lit(0)) for c in rows}).withColumns({"expected_bars": expected, "historical_coverage_ratio": F.coalesce("historical_coverage_ratio", F.lit(0.0))})
    ratio = lambda c: F.when(F.col("expected_bars") <= 0, 0.0).otherwise(F.least(F.col(c) / F.col("expected_bars"), F.lit(1.0)))
    share = lambda c: F.when(F.col("recent_feature_rows_24h") == 0, 0.0).otherwise(F.col(c) / F.col("recent_feature_rows_24h"))
    latest = F.greatest(*[F.col(f"{c}_latest_raw_time") for c in CHANNELS])
    j = j.withColumns({
        "latest_any_raw_time": latest, "coverage_ratio": ratio("recent_feature_rows_24h"), "finalized_ratio": ratio("recent_finalized_rows_24h"),
        **{f"{c}_raw_lag_seconds": lag_seconds(f"{c}_latest_raw_time", as_of) for c in CHANNELS},
        "feature_lag_seconds": lag_seconds("latest_feature_time", as_of), "finalized_lag_minutes": lag_seconds("finalized_through", as_of) / 60.0,
        **{f"recent_{n}_share_24h": share(f"recent_{n}_rows_24h") for n in ("candle_observed", "trade_observed", "orderbook_observed", "execution_observed", "finalized")},
    })
    active = F.coalesce(F.col("latest_any_raw_time") >= as_of - F.expr(f"INTERVAL {active_hours} HOURS"), F.lit(False))
    return j.withColumn("active_recent", active).drop("_earliest", "_from", "_day", "_a", "_b", "_z")


def exchange_health(symbols: DataFrame) -> DataFrame:
    """The rollup by exchange, over active symbols."""
    on = F.col("active_recent")
    act = lambda c: F.when(on, F.col(c))
    return symbols.groupBy("exchange").agg(
        F.count("*").alias("tracked_symbols"), F.count_if(on).alias("active_symbols"), F.count_if(~on).alias("inactive_symbols"),
        F.count_if(on & F.col("candle_5m_latest_raw_time").isNull()).alias("active_symbols_missing_candle_5m"),
        F.count_if(on & (F.col("recent_feature_rows_24h") == 0)).alias("active_symbols_without_recent_features"),
        F.max(act("candle_5m_raw_lag_seconds")).alias("max_candle_5m_raw_lag_seconds"), F.max(act("feature_lag_seconds")).alias("max_feature_lag_seconds"),
        F.avg(act("coverage_ratio")).alias("avg_coverage_ratio"), F.avg(act("finalized_ratio")).alias("avg_finalized_ratio"),
        F.max(act("latest_any_raw_time")).alias("latest_any_raw_time"),
    )


@dataclass(frozen=True)
class Thresholds:
    candle_lag: int = 90
    raw_stale: int = 300
    feature_lag: int = 180
    finalized_lag_minutes: float = 15
    coverage: float = 0.98
    finalized: float = 0.95
    execution_observed: float = 0.5
    trade_observed_for_eligibility: float = 0.2
    required: tuple[str, ...] = ("candle_5m", "trade", "orderbook_l2", "funding")

    def lag(self, channel: str) -> int:
        return self.candle_lag if channel == "candle_5m" else self.raw_stale


def evaluate(symbols: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Q3: liveness class, status, missing, idle and stale channels, and reasons of each symbol."""
    late = lambda c: F.coalesce(F.col(f"{c}_raw_lag_seconds") > t.lag(c), F.lit(False))
    live = F.coalesce(F.col("orderbook_l2_raw_lag_seconds") <= t.raw_stale, F.lit(False))
    on = F.col("active_recent")
    eligible = on & live & (F.col("recent_trade_observed_share_24h") >= t.trade_observed_for_eligibility)
    stale_other = late("orderbook_l2") | late("funding") | late("open_interest")
    sparse = late("trade") | late("candle_5m") | ~eligible
    klass = F.when(~on, "INACTIVE").when(~live | stale_other, "LOCAL_STALE").when(sparse, "LIVE_SPARSE").otherwise("HEALTHY")
    out = symbols.withColumns({"liveness_class": klass, "readiness_eligible": eligible, "_live": live})
    named = lambda test: F.array_compact(F.array(*[F.when(on & test(c), F.lit(c)) for c in t.required]))
    gone = lambda c: F.col(f"{c}_latest_raw_time").isNull()
    idle = lambda c: (~F.col("readiness_eligible") & F.col("_live") & ~gone(c)) if c in ("trade", "candle_5m") else F.lit(False)
    out = out.withColumns({"missing_channels": named(gone), "idle_channels": named(idle)})
    out = out.withColumn("stale_channels", named(lambda c: late(c) & ~F.array_contains("idle_channels", c)))
    is_sparse = F.col("liveness_class") == "LIVE_SPARSE"
    has = lambda a, c: F.array_contains(a, c)
    critical = F.array_compact(F.array(
        F.when(~F.col("_live"), F.lit("execution context not live")), F.when(has("missing_channels", "candle_5m"), F.lit("missing candle_5m")),
        F.when(has("stale_channels", "candle_5m") & ~is_sparse, F.lit("candle_5m lag")), F.when(F.col("latest_feature_time").isNull(), F.lit("no feature rows")),
        F.when(F.coalesce(F.col("feature_lag_seconds") > t.feature_lag, F.lit(True)), F.lit("feature lag")), F.when(F.col("recent_feature_rows_24h") == 0, F.lit("no recent feature rows")),
    ))
    degradable = lambda c: (F.lit(c in ("funding", "orderbook_l2", "open_interest")) | ~is_sparse) & F.lit(c != "candle_5m")
    degraded = F.array_compact(F.array(
        *[F.when(has("missing_channels", c) & degradable(c), F.lit(f"missing {c}")) for c in t.required],
        *[F.when(has("stale_channels", c) & degradable(c), F.lit(f"{c} lag")) for c in t.required],
        F.when(is_sparse, F.lit("live sparse market")), F.when(F.col("coverage_ratio") < t.coverage, F.lit("coverage")), F.when(F.col("finalized_ratio") < t.finalized, F.lit("finalized coverage")),
        F.when(F.coalesce(F.col("finalized_lag_minutes") > t.finalized_lag_minutes, F.lit(True)), F.lit("finalized lag")),
        F.when((F.col("recent_feature_rows_24h") > 0) & (F.col("recent_execution_observed_share_24h") < t.execution_observed), F.lit("execution observed")),
    ))
    out = out.withColumns({"_critical": critical, "_degraded": degraded})
    quiet = ~F.col("readiness_eligible") & F.col("_live")
    status = F.when(~on, "INACTIVE").when(quiet, "IDLE_LIVE").when(F.size("_critical") > 0, "CRITICAL").when(F.size("_degraded") > 0, "DEGRADED").otherwise("HEALTHY")
    reasons = F.when(~on, F.array(F.lit("no recent raw activity"))).when(quiet, F.concat(F.array(F.lit("idle but live")), F.transform("idle_channels", lambda c: F.concat(c, F.lit(" idle but live"))))).otherwise(F.concat("_critical", "_degraded"))
    return out.withColumns({"status": status, "reasons": reasons}).drop("_critical", "_degraded", "_live")


ISSUE_RANK = {"CRITICAL": 0, "DEGRADED": 1, "IDLE_LIVE": 2, "INACTIVE": 3, "HEALTHY": 4}


def issues(evaluated: DataFrame, limit: int = 100) -> DataFrame:
    """Worst first, then by lags and symbol; a report of 1 to 500 rows."""
    rank = F.coalesce(*[F.when(F.col("status") == s, F.lit(r)) for s, r in ISSUE_RANK.items()])
    return evaluated.filter("status <> 'HEALTHY'").orderBy(rank, F.desc_nulls_last("feature_lag_seconds"), F.desc_nulls_last("candle_5m_raw_lag_seconds"), "exchange", "symbol").limit(max(1, min(500, limit)))


def summary(evaluated: DataFrame, sample: int = 12) -> DataFrame:
    """Counts by status, averages and maxima, and the first critical symbols."""
    critical = F.array_sort(F.collect_set(F.when(F.col("status") == "CRITICAL", F.concat_ws(":", "exchange", "symbol"))))
    return evaluated.agg(
        F.count("*").alias("symbols"), *[F.count_if(F.col("status") == s).alias(f"{s.lower()}_symbols") for s in ISSUE_RANK],
        F.count_if("readiness_eligible").alias("eligible_symbols"), F.avg("coverage_ratio").alias("avg_coverage_ratio"), F.avg("finalized_ratio").alias("avg_finalized_ratio"),
        F.max("feature_lag_seconds").alias("max_feature_lag_seconds"), F.slice(critical, 1, sample).alias("critical_sample"),
    )


def counters(evaluated: DataFrame, t: Thresholds = Thresholds(), sample: int = 12) -> DataFrame:
    """The whole summary in one row: symbols by state and by what fails, averages and longest lags of the active ones,
    and the critical symbols with the longest candle lag (never seen first; ties by name). A report of ``sample`` names."""
    on = F.col("active_recent")
    fails = {
        "symbols_missing_required_channels": F.size("missing_channels") > 0, "stale_candle_symbols": F.array_contains("stale_channels", "candle_5m"),
        "stale_feature_symbols": F.coalesce(F.col("feature_lag_seconds") > t.feature_lag, F.lit(True)), "coverage_fail_symbols": F.col("coverage_ratio") < t.coverage, "finalized_fail_symbols": F.col("finalized_ratio") < t.finalized,
        "execution_fail_symbols": (F.col("liveness_class") != "LIVE_SPARSE") & (
            (F.col("recent_feature_rows_24h") > 0) & (F.col("recent_execution_observed_share_24h") < t.execution_observed) | F.exists("missing_channels", lambda c: c != "candle_5m")
            | F.exists("stale_channels", lambda c: c != "candle_5m") | ~F.col("readiness_eligible") & (F.col("status") != "IDLE_LIVE")
        ),
    }
    counted = {"active_symbols": on, "eligible_symbols": F.col("readiness_eligible"), "inactive_symbols": ~on, "live_sparse_symbols": F.col("liveness_class") == "LIVE_SPARSE"}
    counted |= {f"{s.lower()}_symbols": F.col("status") == s for s in ("IDLE_LIVE", "HEALTHY", "DEGRADED", "CRITICAL")}
    mean = lambda c: F.coalesce(F.avg(F.when(on, F.col(c))), F.lit(0.0))
    most = lambda c: F.coalesce(F.max(F.when(on, F.coalesce(F.col(c), F.lit(0)))), F.lit(0))
    g = evaluated.agg(
        F.count("*").alias("tracked_symbols"), *[F.count_if(c).alias(n) for n, c in counted.items()], *[F.count_if(on & c).alias(n) for n, c in fails.items()],
        mean("coverage_ratio").alias("avg_coverage_ratio_active"), mean("finalized_ratio").alias("avg_finalized_ratio_active"), mean("recent_execution_observed_share_24h").alias("avg_recent_execution_observed_share_24h_active"),
        most("candle_5m_raw_lag_seconds").alias("max_candle_lag_seconds_active"), most("feature_lag_seconds").alias("max_feature_lag_seconds_active"),
    )
    worst = evaluated.filter("status = 'CRITICAL'").orderBy(F.desc_nulls_first("candle_5m_raw_lag_seconds"), "exchange", "symbol").limit(sample)
    order = F.row_number().over(Window.orderBy(F.desc_nulls_first("candle_5m_raw_lag_seconds"), "exchange", "symbol"))
    names = worst.select(order.alias("k"), "symbol").agg(F.array_sort(F.collect_list(F.struct("k", "symbol"))).alias("s")).select(F.col("s.symbol").alias("critical_sample"))
    return g.crossJoin(names)  # both of one row


def venue_sanity(local: DataFrame, external: DataFrame) -> DataFrame:
    """Q5: presence of each symbol here and at the venue, and what that means."""
    j = external.select("symbol", F.col("active").alias("listed")).join(local.select("symbol", "active_recent"), "symbol", "full_outer")
    here, there = F.coalesce("active_recent", F.lit(False)), F.coalesce("listed", F.lit(False))
    return j.select("symbol", F.when(here & there, "MATCHED").when(there, "LOCAL_MISSING").when(here, "EXTERNAL_MISSING").otherwise("INACTIVE").alias("presence"))


def check_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``accepted`` and the names of the rules that a row breaks. A rule that can't be judged is broken."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)


def full_universe(universe: DataFrame, rows: DataFrame, defaults: dict) -> DataFrame:
    """Every symbol of the authoritative universe; absent ones get the defaults."""
    return universe.join(rows, ["exchange", "symbol"], "left").fillna(defaults)
