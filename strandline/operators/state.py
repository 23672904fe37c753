"""Keyed state: merges with rules, sync state, coverage, finalisation, gaps and repair plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.columns import align_down, bucket, bucket_seconds

# ---- K1: merge with rules ----------------------------------------------------------------------


def merge(base: DataFrame, delta: DataFrame, keys: list[str], rules: dict[str, str], time: str | None = None) -> DataFrame:
    """K1: one row a key; each column by its rule: replace, add, least, greatest, or, first (non-null), latest (by ``time``, delta on ties).

    Both sides hold a key once. The result is a plain frame; write it to a new path or by dynamic partition overwrite.
    """
    b = base.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in rules], F.lit(True).alias("_in_b"))
    d = delta.select(*keys, *[F.col(c).alias(f"_d_{c}") for c in rules], F.lit(True).alias("_in_d"))
    newer = F.lit(True) if time is None else F.col(f"_b_{time}").isNull() | (F.col(f"_d_{time}") >= F.col(f"_b_{time}"))

    def rule(c: str, kind: str) -> Column:
        old, new = F.col(f"_b_{c}"), F.col(f"_d_{c}")
        both = F.col("_in_b").isNotNull() & F.col("_in_d").isNotNull()
        made = {
            "replace": lambda: F.when(F.col("_in_d").isNotNull(), new).otherwise(old),
            "add": lambda: F.when(both, F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))).otherwise(F.coalesce(old, new)),
            "least": lambda: F.least(old, new),
            "greatest": lambda: F.greatest(old, new),
            "or": lambda: F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False)),
            "first": lambda: F.coalesce(old, new),
            "latest": lambda: F.when(F.col("_in_d").isNotNull() & newer, new).otherwise(old),
        }
        return made[kind]().alias(c)

    return b.join(d, keys, "full_outer").select(*keys, *[rule(c, k) for c, k in rules.items()])


def refresh(stored: DataFrame, fresh: DataFrame, keys: list[str], values: list[str], since: Column) -> DataFrame:
    """ST3, ST8: ``stored`` bars with those from ``since`` on computed anew.

    Late rows change the values of a final bar, but it stays final and keeps the time at which it became so. Bars that only
    one side has stay as they are. Both sides hold a key once and have the flags of ``bars.finality``.
    """
    rules = {c: "replace" for c in [*values, "finalization_due_at"]} | {"is_finalized": "or", "finalized_at": "first"}
    made = merge(stored, fresh.filter(F.col("time") >= since), keys, rules)
    return made.withColumn("is_provisional", ~F.col("is_finalized"))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """K2: the row of each key that was ingested last."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def insert_ignore(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """K2, IO10: the rows of ``delta`` whose key is new, once."""
    return delta.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti")


def sentiment_unique(rows: DataFrame) -> DataFrame:
    """K3: unique by source, symbol, time and the url and title with null as the empty string."""
    keyed = rows.withColumns({"_url": F.coalesce("article_url", F.lit("")), "_title": F.coalesce("article_title", F.lit(""))})
    return keyed.dropDuplicates(["source", "symbol", "observed_at", "_url", "_title"]).drop("_url", "_title")


# ---- sync, materialisation and coverage --------------------------------------------------------


def raw_bounds(rows: DataFrame, channel: str, width: str | None = None) -> DataFrame:
    """Bounds and row count of one channel, as a sync state."""
    return rows.groupBy("exchange", "symbol").agg(F.min("time").alias("earliest_raw_time"), F.max("time").alias("latest_raw_time"), F.count("*").alias("row_count")).select("exchange", "symbol", F.lit(channel).alias("channel"), "earliest_raw_time", "latest_raw_time", "row_count")


SYNC_RULES = {"earliest_raw_time": "least", "latest_raw_time": "greatest", "row_count": "add"}


def sync_state(channels: dict[str, DataFrame], base: DataFrame | None = None) -> DataFrame:
    """K4, K5: the sync state of all channels, merged into ``base`` where there is one."""
    delta = reduce(DataFrame.union, [raw_bounds(df, name) for name, df in channels.items()])
    return delta if base is None else merge(base, delta, ["exchange", "symbol", "channel"], SYNC_RULES)


def materialisation_state(bars: DataFrame) -> DataFrame:
    """Feature bounds, finalised-through, observed and finalised bars (recomputed in full, T11)."""
    return bars.groupBy("exchange", "symbol").agg(*_bounds())


def _bounds() -> list[Column]:
    return [
        F.min("time").alias("earliest_feature_time"), F.max("time").alias("latest_feature_time"), F.max(F.when(F.col("is_finalized"), F.col("time"))).alias("finalized_through"),
        F.count("*").alias("feature_rows"), F.count_if("is_finalized").alias("finalized_bars"),
    ]


def feature_partials(bars: DataFrame) -> DataFrame:
    """K6: mergeable parts of the materialisation state, one row a (exchange, symbol, day)."""
    return bars.groupBy("exchange", "symbol", F.to_date("time").alias("day")).agg(*_bounds())


def refreshed_partials(held: DataFrame, bars: DataFrame, changed: DataFrame) -> DataFrame:
    """K6: ``held`` parts with those of the days in ``changed`` (exchange, symbol, time) made anew from ``bars``.

    Only those days of ``bars`` are read. A day that has no bars any more has no part. Run twice, the result is the same,
    and rows that come again are never added up (T11).
    """
    days = changed.select("exchange", "symbol", F.to_date("time").alias("day")).distinct()
    near = bars.withColumn("day", F.to_date("time")).join(days, ["exchange", "symbol", "day"], "left_semi").drop("day")
    return held.join(days, ["exchange", "symbol", "day"], "left_anti").unionByName(feature_partials(near))


def state_of_partials(parts: DataFrame) -> DataFrame:
    """K6: the materialisation state from its parts, without another look at the bars."""
    return parts.groupBy("exchange", "symbol").agg(
        F.min("earliest_feature_time").alias("earliest_feature_time"), F.max("latest_feature_time").alias("latest_feature_time"), F.max("finalized_through").alias("finalized_through"),
        F.sum("feature_rows").alias("feature_rows"), F.sum("finalized_bars").alias("finalized_bars"),
    )


def coverage_state(bounds: DataFrame, bars: DataFrame, width_minutes: int) -> DataFrame:
    """Expected bars from the raw bounds, observed and finalised ratios capped at 1."""
    raw = bounds.groupBy("exchange", "symbol").agg(F.min("earliest_raw_time").alias("lo"), F.max("latest_raw_time").alias("hi"))
    raw = raw.withColumns({"_lo": bucket_seconds("lo", width_minutes), "_hi": bucket_seconds("hi", width_minutes)})
    j = materialisation_state(bars).withColumnRenamed("feature_rows", "observed_bars").join(raw, ["exchange", "symbol"], "full_outer")
    expected = F.coalesce(((F.col("_hi") - F.col("_lo")) / (width_minutes * 60)).cast("long") + 1, F.col("observed_bars"))
    j = j.withColumns({"observed_bars": F.coalesce("observed_bars", F.lit(0)), "finalized_bars": F.coalesce("finalized_bars", F.lit(0))}).withColumn("expected_bars", expected)
    ratio = lambda c: F.when(F.col("expected_bars") > 0, F.least(F.col(c) / F.col("expected_bars"), F.lit(1.0))).otherwise(0.0)
    return j.select("exchange", "symbol", F.col("lo").alias("earliest_raw_time"), F.col("hi").alias("latest_raw_time"), "expected_bars", "observed_bars", "finalized_bars", ratio("observed_bars").alias("coverage_ratio"), ratio("finalized_bars").alias("finalized_ratio"))


def distinct_coverage(bars: DataFrame, expected: int) -> DataFrame:
    """Distinct buckets over the expected number; null where nothing is expected."""
    return bars.groupBy("exchange", "symbol").agg(F.count_distinct("time").alias("buckets")).withColumn("coverage", F.when(F.lit(expected) > 0, F.col("buckets") / F.lit(expected)))


def finalise_due(bars: DataFrame, as_of: Column) -> DataFrame:
    """K8: due rows become final; a first ``finalized_at`` is kept; ``changed`` tells which flipped."""
    due = ~F.col("is_finalized") & (F.col("finalization_due_at") <= as_of)
    return bars.withColumn("changed", due).withColumns({"is_finalized": F.col("is_finalized") | due, "is_provisional": F.col("is_provisional") & ~due, "finalized_at": F.coalesce("finalized_at", F.when(due, as_of))})


def finalise_report(bars: DataFrame) -> DataFrame:
    """K8: how many rows flipped, and the window that they span."""
    return bars.filter("changed").groupBy("exchange").agg(F.count("*").alias("finalized_rows"), F.min("time").alias("window_start"), F.max("time").alias("window_end"))


def source_runs(runs: DataFrame) -> DataFrame:
    """Totals of each source's run log, and the failures since its last success."""
    last_ok = runs.groupBy("source").agg(F.max(F.when(F.col("ok"), F.col("run_at"))).alias("last_ok"))
    j = runs.join(last_ok, "source")
    return j.groupBy("source").agg(
        F.count("*").alias("runs"), F.sum("processed").alias("processed"), F.sum("failed").alias("failed"), F.max("last_ok").alias("last_success"),
        F.count_if(~F.col("ok") & (F.col("last_ok").isNull() | (F.col("run_at") > F.col("last_ok")))).alias("consecutive_failures"),
    )


def status_counts(docs: DataFrame, statuses: list[str]) -> DataFrame:
    """Documents by source and status, zero where there are none."""
    found = docs.groupBy("source", "embedding_status").agg(F.count("*").alias("n"))
    spine = docs.select("source").distinct().select("source", F.explode(F.array(*[F.lit(s) for s in statuses])).alias("embedding_status"))
    return spine.join(found, ["source", "embedding_status"], "left").select("source", "embedding_status", F.coalesce("n", F.lit(0)).alias("n"))


def transition(docs: DataFrame, results: DataFrame, max_retries: int = 3) -> DataFrame:
    """Apply embedding results (id, ok, error); a failure is retried until ``max_retries``."""
    j = docs.join(results.select("id", "ok", "error"), "id", "left")
    retries = F.col("retry_count") + F.when(F.col("ok") == F.lit(False), 1).otherwise(0)
    status = F.when(F.col("ok").isNull(), F.col("embedding_status")).when(F.col("ok"), F.lit("COMPLETED")).when(retries < max_retries, F.lit("PENDING")).otherwise(F.lit("FAILED"))
    return j.withColumns({"retry_count": retries, "embedding_status": status, "error_message": F.when(F.col("ok") == F.lit(False), F.col("error")).when(F.col("ok"), F.lit(None)).otherwise(F.col("error_message"))}).drop("ok", "error")


# ---- gaps and plans ------------------------------------------------------------------------------


def repair_times(candle_times: DataFrame, bars: DataFrame, newest: int) -> DataFrame:
    """Candle times without a bar, or with one whose candle wasn't observed; the newest ``newest``."""
    b = bars.select("time", "symbol", "exchange", F.col("candle_observed").alias("_seen"))
    lacking = candle_times.select("time", "symbol", "exchange").distinct().join(b, ["time", "symbol", "exchange"], "left").filter("_seen IS NULL OR NOT _seen")
    return lacking.select("time", "symbol", "exchange").orderBy(F.desc("time"), "symbol", "exchange").limit(newest)


def missing_buckets(times: DataFrame, start: Column, end: Column, minutes: int) -> DataFrame:
    """The buckets of [start, end) without a row, by symbol: earliest, latest and number."""
    width = f"{minutes} minutes"
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    spine = times.select("symbol").distinct().select("symbol", F.explode(F.sequence(start, end - step, step)).alias("time"))
    had = times.select("symbol", bucket("time", width).alias("time")).distinct()
    return spine.join(had, ["symbol", "time"], "left_anti").groupBy("symbol").agg(F.min("time").alias("earliest_missing"), F.max("time").alias("latest_missing"), F.count("*").alias("missing"))


def gap_candidates(missing: DataFrame, minutes: int = 30) -> DataFrame:
    """Q7: the range to repair: from the earliest missing bucket to the end of the latest."""
    return missing.select("symbol", F.col("earliest_missing").alias("gap_start"), (F.col("latest_missing") + F.expr(f"INTERVAL {minutes - 1} MINUTES")).alias("gap_end"), "missing")


def backfill_ranges(bounds: DataFrame, target_start: Column, as_of: Column, tolerance_minutes: int = 60) -> DataFrame:
    """Q10: one range for each symbol: the tail after its latest row if that is stale, else the head before its first."""
    slack = F.expr(f"INTERVAL {tolerance_minutes} MINUTES")
    stale = F.col("latest_raw_time") < as_of - slack
    short = F.col("earliest_raw_time") > target_start + slack
    return bounds.withColumns({
        "part": F.when(F.col("latest_raw_time").isNull(), F.lit("full")).when(stale, F.lit("tail")).when(short, F.lit("head")),
        "range_start": F.when(F.col("latest_raw_time").isNull(), target_start).when(stale, F.greatest(F.col("latest_raw_time"), target_start)).when(short, target_start),
        "range_end": F.when(F.col("latest_raw_time").isNull() | stale, as_of).when(short, F.least(F.col("earliest_raw_time"), as_of)),
    }).filter("part IS NOT NULL")


def time_windows(ranges: DataFrame, start: str, end: str, minutes: int) -> DataFrame:
    """[start, end) of each row cut into windows of ``minutes``, the last one shorter; ``window_no`` counts from the newest."""
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    cut = ranges.filter(F.col(start) < F.col(end)).withColumn("window_start", F.explode(F.sequence(F.col(start), F.col(end), step))).filter(F.col("window_start") < F.col(end))
    total = F.ceil((F.unix_timestamp(end) - F.unix_timestamp(start)) / (minutes * 60))
    index = ((F.unix_timestamp("window_start") - F.unix_timestamp(start)) / (minutes * 60)).cast("long")
    return cut.withColumns({"window_end": F.least(F.col("window_start") + step, F.col(end)), "window_no": total - index})


def paged_windows(ranges: DataFrame, start: str, end: str, interval_ms: int, max_bars: int, overlap: int) -> DataFrame:
    """pages of at most ``max_bars`` bars, newest first, each overlapping the newer one by ``overlap`` bars."""
    step = (max_bars - overlap) * interval_ms
    lo, hi = F.unix_millis(start), F.unix_millis(end)
    last = F.floor(hi / interval_ms) * interval_ms
    lo = F.floor(lo / interval_ms) * interval_ms
    pages = F.greatest(F.ceil((last - lo + interval_ms - max_bars * interval_ms) / F.lit(step)) + 1, F.lit(1)).cast("long")
    paged = ranges.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), pages - 1)))
    begin = F.greatest(last - (max_bars - 1) * interval_ms - F.col("page") * step, lo)
    finish = F.when(F.col("page") == 0, hi).otherwise(last - F.col("page") * step + interval_ms - 1)
    return paged.withColumns({"page_start": F.timestamp_millis(begin.cast("long")), "page_end": F.timestamp_millis(finish.cast("long"))})


def stale_streams(trades: DataFrame, bars: DataFrame, interval_minutes: int, allowed_minutes: int) -> DataFrame:
    """Q8: symbols whose last bar is older than their trades say it should be."""
    t = trades.groupBy("symbol").agg(F.max("time").alias("last_trade"))
    b = bars.groupBy("symbol").agg(F.max("time").alias("last_bar"))
    expected = bucket("last_trade", f"{interval_minutes} minutes")
    j = t.withColumn("expected_bar", expected).join(b, "symbol", "left")
    return j.withColumn("stale", F.col("last_bar").isNull() | (F.col("last_bar") + F.expr(f"INTERVAL {allowed_minutes} MINUTES") < F.col("expected_bar")))


def choose_source(requests: DataFrame, sources: list[tuple[str, DataFrame]], expected: int, least: float) -> DataFrame:
    """Q12: for each requested symbol the first source whose distinct bars reach ``least`` of the expected number."""
    chosen = requests.select("symbol")
    for name, bars in sources:
        n = bars.groupBy("symbol").agg(F.count_distinct("time").alias(f"_{name}"))
        chosen = chosen.join(n, "symbol", "left")
    picks = [F.when(F.coalesce(F.col(f"_{name}"), F.lit(0)) / expected >= least, F.lit(name)) for name, _ in sources]
    return chosen.select("symbol", F.coalesce(*picks).alias("source"))


def newest_windows(ranges: DataFrame, start: str, end: str, minutes: int, most: int) -> DataFrame:
    """The newest ``most`` windows of each row's [start, end) (a plan takes so many a cycle)."""
    return time_windows(ranges, start, end, minutes).filter(F.col("window_no") <= most)


_PLAN = ("exchange", "symbol", "window_start", "window_end", "window_no")


def catch_up_windows(bounds: DataFrame, now: Column, bootstrap_hours: int, overlap_minutes: int, chunk_hours: int, most: int) -> DataFrame:
    """Q11: windows of raw history (``raw_start``) before the first features (``feature_start``), as far back as ``bootstrap_hours``."""
    floor = F.greatest(F.col("raw_start"), now - F.expr(f"INTERVAL {bootstrap_hours} HOURS"))
    plan = bounds.withColumns({"_from": floor, "_to": F.least(now, F.col("feature_start") + F.expr(f"INTERVAL {overlap_minutes} MINUTES"))})
    return newest_windows(plan.filter(F.col("_from") < F.col("feature_start")), "_from", "_to", chunk_hours * 60, most).select(*_PLAN)


def frontier_windows(bounds: DataFrame, now: Column, overlap_minutes: int, lag_minutes: int, window_minutes: int, most: int, bar_minutes: int = 5) -> DataFrame:
    """Q11: windows from the bar after ``latest_finalized`` up to the newest bar that can be final."""
    bar = F.expr(f"INTERVAL {bar_minutes} MINUTES")
    aligned = lambda t: align_down(t, bar_minutes * 60_000)
    b = bounds.withColumn("_to", aligned(now - F.expr(f"INTERVAL {max(0, bar_minutes + lag_minutes)} MINUTES")) + bar)
    first = aligned(F.col("_to") - F.expr(f"INTERVAL {max(1, overlap_minutes)} MINUTES"))
    b = b.withColumn("_from", F.coalesce(aligned(F.col("latest_finalized")) + bar, first))
    return newest_windows(b, "_from", "_to", min(max(1, window_minutes), max(1, overlap_minutes)), most).select(*_PLAN)


def gap_repair_windows(ranges: DataFrame, start: str, end: str, cursor: Column, minutes: int, most: int) -> DataFrame:
    """Q11: the newest ``most`` windows that end at the cursor or before, all of them eligible again when none is left.

    ``next_cursor`` is the start of the oldest window taken, or the range's end once its start is reached. A cursor outside
    (start, end] counts as the end.
    """
    valid = F.when((cursor > F.col(start)) & (cursor <= F.col(end)), cursor).otherwise(F.col(end))
    cut = time_windows(ranges.withColumn("_cursor", valid), start, end, minutes)
    # Windows are counted from the newest, so how many end after the cursor follows from the range, without a window.
    total = F.ceil((F.unix_timestamp(end) - F.unix_timestamp(start)) / (minutes * 60))
    ended = F.when(F.col("_cursor") == F.col(end), total).otherwise(F.floor((F.unix_timestamp("_cursor") - F.unix_timestamp(start)) / (minutes * 60)))
    skipped = F.when(ended > 0, total - ended).otherwise(0)
    taken = cut.withColumn("_skipped", skipped).filter((F.col("window_no") > F.col("_skipped")) & (F.col("window_no") <= F.col("_skipped") + most))
    oldest_no = F.least(F.col("_skipped") + most, total)
    oldest = F.timestamp_seconds(F.unix_timestamp(start) + (total - oldest_no) * minutes * 60)
    return taken.withColumn("next_cursor", F.when(oldest > F.col(start), oldest).otherwise(F.col(end))).drop("_cursor", "_skipped")


def halve(ranges: DataFrame, start: str, end: str, least_minutes: int) -> DataFrame:
    """each range in two, the first half at least ``least_minutes`` long; ranges that short stay whole."""
    least_minutes = max(1, least_minutes)
    span = F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 60)
    left = F.greatest(F.floor(span / 2), F.lit(least_minutes).cast("long"))
    middle = F.timestamp_seconds(F.unix_timestamp(start) + left * 60)
    part = lambda a, b: F.struct(a.alias("window_start"), b.alias("window_end"))
    whole = (span <= least_minutes) | (span - left <= 0)
    parts = F.when(whole, F.array(part(F.col(start), F.col(end)))).otherwise(F.array(part(middle, F.col(end)), part(F.col(start), middle)))
    return ranges.withColumn("_part", F.explode(parts)).select("*", "_part.*").drop("_part")


def merge_windows(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """the span of both windows of a key; a key that ``b`` lacks keeps its own."""
    other = b.select(*by, F.col("window_start").alias("_s"), F.col("window_end").alias("_e"))
    spans = {"window_start": F.least("window_start", "_s"), "window_end": F.greatest("window_end", "_e")}
    return a.join(other, by, "left").withColumns(spans).drop("_s", "_e")


def expand_to_days(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """the whole UTC days that [start, end) touches."""
    last = F.date_trunc("day", F.col(end) - F.expr("INTERVAL 1 MILLISECOND"))
    return ranges.withColumns({"window_start": F.date_trunc("day", start), "window_end": last + F.expr("INTERVAL 1 DAY")})


def status_lags(df: DataFrame, by: list[str], tests: dict[str, Column], time: str, now: Column) -> DataFrame:
    """Rows, the number and percentage that pass each test, and the seconds since the newest row."""
    g = df.groupBy(*by).agg(F.count("*").alias("rows"), *[F.count_if(t).alias(n) for n, t in tests.items()], F.max(time).alias("_newest"))
    lag = F.greatest(F.unix_timestamp(now) - F.unix_timestamp("_newest"), F.lit(0)).cast("long")
    return g.select(*by, "rows", *[c for n in tests for c in (F.col(n), (F.col(n) * 100.0 / F.col("rows")).alias(f"{n}_pct"))], lag.alias("lag_seconds"))
