"""Ordered features of a symbol: panel grid, as-of join, rolling windows and indicators.

Rolling windows are partitioned by symbol; recursive averages and the as-of join spread a symbol over blocks of time.
Every frame that must be complete is gated on the number of bars in it, as a missing bar makes the feature null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.columns import frame
from strandline.operators.scans import DAY, affine_scan, last_value_scan

BY = ["symbol"]


def panel_grid(bars: DataFrame) -> DataFrame:
    """Every (time, symbol) of the panel, with nulls where a bar is missing."""
    grid = bars.select("time").distinct().crossJoin(bars.select("symbol").distinct())
    return grid.join(bars, ["time", "symbol"], "left")


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], value: str, time: str = "time", width: int = DAY) -> DataFrame:
    """The latest non-null ``value`` of ``right`` at or before each row of ``left``.

    A union and a running last value over blocks of ``width`` seconds, so that a key of any length spreads over tasks. At
    equal times the right row comes first and so counts. A left row without a time has no value.
    """
    l = left.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(right.schema[value].dataType)})  # noqa: E741
    r = right.filter(F.col(value).isNotNull() & F.col(time).isNotNull())
    r = r.select(*[F.col(c) if c in by + [time] else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.lit(0).alias("_side"), F.col(value).alias("_value"))
    return last_value_scan(l.unionByName(r), by, [time, "_side"], "_value", value, width).filter("_side = 1").drop("_side", "_value")


def at_least(x: Column, lo: float) -> Column:
    """``x`` but not below ``lo``; null stays null (``greatest`` would skip it)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(lo)))


def _lag(c: str, n: int = 1) -> Column:
    return F.lag(c, n).over(Window.partitionBy(*BY).orderBy("time"))


def log_return(c: str = "close") -> Column:
    """ln(c / previous c); null unless both are positive."""
    return F.when((F.col(c) > 0) & (_lag(c) > 0), F.ln(F.col(c) / _lag(c)))


def _over(agg: Column, value: str | Column, n: int) -> Column:
    """An aggregate over the last ``n`` rows, null unless all of them hold the value."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(F.count(v).over(frame(BY, "time", n - 1)) == n, agg.over(frame(BY, "time", n - 1)))


def with_returns(df: DataFrame) -> DataFrame:
    return df.withColumn("r", log_return())


def rolling_volatility(n: int, r: str = "r") -> Column:
    """Root of the mean squared return over ``n`` returns, at least 1e-4."""
    return F.sqrt(at_least(_over(F.avg(F.col(r) * F.col(r)), r, n), 1e-8))


def _change(n: int, c: str = "close") -> Column:
    past = _lag(c, n)
    return F.when((F.col(c) > 0) & (past > 0), F.ln(F.col(c) / past))


def scaled_return(n: int) -> Column:
    """The log change over ``n`` bars by the volatility of max(n / 2, 3) bars."""
    return _change(n) / at_least(rolling_volatility(max(n // 2, 3)), 1e-4)


def sma_spread(fast: int, slow: int) -> Column:
    """Fast average over slow average, less one."""
    f, s = _over(F.avg("close"), "close", fast), _over(F.avg("close"), "close", slow)
    return F.when(s > 0, f / s - 1.0)


def t_statistic(n: int) -> Column:
    """T of the regression of ln close on the bar number over ``n`` bars, in closed form."""
    y = F.when(F.col("close") > 0, F.ln("close"))
    i = F.row_number().over(Window.partitionBy(*BY).orderBy("time"))
    w = frame(BY, "time", n - 1)
    sxx = n * (n * n - 1) / 12.0
    syy = F.var_pop(y).over(w) * n
    sxy = F.covar_pop(i.cast("double"), y).over(w) * n
    slope = sxy / sxx
    residual = F.greatest(syy - slope * sxy, F.lit(0.0))
    error = F.sqrt(F.greatest(residual / max(n - 2, 1) / sxx, F.lit(1e-12)))
    return F.when(F.count(y).over(w) == n, slope / error)


def with_directional_moves(df: DataFrame) -> DataFrame:
    up, down = F.col("high") - _lag("high"), _lag("low") - F.col("low")
    return df.withColumns({
        "_up": F.when(up.isNull(), None).when((up > down) & (up > 0), up).otherwise(0.0),
        "_down": F.when(down.isNull(), None).when((down > up) & (down > 0), down).otherwise(0.0),
        "_tr": F.when(_lag("close").isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - _lag("close")), F.abs(F.col("low") - _lag("close")))),
    })


def directional_index(n: int) -> Column:
    """Unsmoothed directional index over ``n`` moves (after ``with_directional_moves``)."""
    tr = F.greatest(_over(F.avg("_tr"), "_tr", n), F.lit(1e-9))
    plus, minus = 100.0 * _over(F.avg("_up"), "_tr", n) / tr, 100.0 * _over(F.avg("_down"), "_tr", n) / tr
    return 100.0 * F.abs(plus - minus) / F.greatest(plus + minus, F.lit(1e-9))


def perturbation(n: int, volatility: Column) -> Column:
    """The log change over ``n`` bars by the volatility."""
    return _change(n) / at_least(volatility, 1e-4)


def interest_momentum(n: int) -> Column:
    """W11."""
    return _change(n, "open_interest")


def ema_weights(n: int) -> list[float]:
    """Weights of the last ``n`` closes (oldest first) in an average seeded by their mean and folded over the last n - 1."""
    alpha = 2.0 / (n + 1.0)
    out = []
    for k in range(n):
        own = alpha * (1 - alpha) ** (n - 1 - k) if k else 0.0
        out.append(own + (1 - alpha) ** (n - 1) / n)
    return out


def ema_distance(n: int, volatility: Column) -> Column:
    """ln(close / finite-window average) by the volatility; the fixed weights make it a dot product."""
    w = frame(BY, "time", n - 1)
    closes = F.collect_list("close").over(w)
    ema = F.aggregate(F.zip_with(closes, F.array(*[F.lit(x) for x in ema_weights(n)]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.count("close").over(w) == n, F.ln(F.try_divide(F.col("close"), ema))) / at_least(volatility, 1e-4)


def directional_persistence(n: int, r: str = "r") -> Column:
    """The directional index of a return series."""
    up = _over(F.avg(F.greatest(F.col(r), F.lit(0.0))), r, n)
    down = _over(F.avg(F.greatest(-F.col(r), F.lit(0.0))), r, n)
    return 100.0 * F.abs(up - down) / F.greatest(up + down, F.lit(1e-9))


def summed_return(n: int, r: str = "r") -> Column:
    """The sum of ``n`` returns by the volatility of max(n / 2, 3) of them."""
    return _over(F.sum(r), r, n) / at_least(rolling_volatility(max(n // 2, 3), r), 1e-4)


def rolling_z(c: str, n: int) -> Column:
    """The deviation from the mean of ``n`` rows in sample standard deviations."""
    sd = _over(F.stddev_samp(c), c, n)
    return F.when(sd > 0, (F.col(c) - _over(F.avg(c), c, n)) / sd)


def rolling_median(c: str, n: int) -> Column:
    """Median of the last ``n`` rows, from the sorted frame (frames are bounded)."""
    values = F.array_sort(F.collect_list(c).over(frame(BY, "time", n - 1)))
    k = F.size(values)
    return F.when(k == n, (F.element_at(values, F.floor((k + 1) / 2).cast("int")) + F.element_at(values, F.ceil((k + 1) / 2).cast("int"))) / 2.0)


def relative_to_median(c: str, n: int) -> Column:
    """A value over its median of the last ``n`` rows; null where that is zero or rows are missing."""
    return F.try_divide(F.col(c), rolling_median(c, n))


def ema(df: DataFrame, spans: dict[str, int], c: str = "close", by: list[str] = BY, width: int = DAY) -> DataFrame:
    """Recursive averages seeded with the first value; a row without a value keeps the average of the one before.

    A blocked scan (``scans``): no task holds a symbol, all spans in one pass.
    """
    maps = {name: (F.lit(1.0 - 2.0 / (n + 1.0)), 2.0 / (n + 1.0) * F.col(c), F.col(c)) for name, n in spans.items()}
    return affine_scan(df, by, "time", maps, width)


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Difference of two recursive averages, its own average, and the histogram."""
    d = ema(df, {"_f": fast, "_s": slow}).withColumn("macd", F.col("_f") - F.col("_s")).drop("_f", "_s")
    return ema(d, {"macd_signal": signal}, c="macd").withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def drawdown(df: DataFrame, r: str = "r") -> DataFrame:
    """Equity, running peak and drawdown of a return series."""
    w = Window.partitionBy(*BY).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("equity", F.exp(F.sum(F.log1p(F.coalesce(F.col(r), F.lit(0.0)))).over(w)))
    return out.withColumn("peak", F.max("equity").over(w)).withColumn("drawdown", F.col("equity") / F.col("peak") - 1.0)


def forward_fill(df: DataFrame, c: str, out: str) -> DataFrame:
    """The last decision that was made."""
    w = Window.partitionBy(*BY).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(c, ignorenulls=True).over(w))


def forward_residual(df: DataFrame, horizon: int) -> DataFrame:
    """The log change over the next ``horizon`` bars less its median over all symbols at that time."""
    ahead = F.lead("close", horizon).over(Window.partitionBy(*BY).orderBy("time"))
    out = df.withColumn("forward", F.when((F.col("close") > 0) & (ahead > 0), F.ln(ahead / F.col("close"))))
    mid = out.groupBy("time").agg(F.median("forward").alias("_mid"))
    return out.join(mid, "time").withColumn("residual", F.col("forward") - F.col("_mid")).drop("_mid")


# ---- indicators ----------------------------------------------------------------------------------


def sma(n: int) -> Column:
    """I1."""
    return _over(F.avg("close"), "close", n)


def with_moves(df: DataFrame) -> DataFrame:
    change = F.col("close") - _lag("close")
    first = _lag("close").isNull()
    return df.withColumns({
        "_gain": F.when(~first, F.greatest(change, F.lit(0.0))), "_loss": F.when(~first, F.greatest(-change, F.lit(0.0))),
        "_range": F.when(first, F.col("high") - F.col("low")).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - _lag("close")), F.abs(F.col("low") - _lag("close")))),
    })


def rsi(n: int) -> Column:
    """Plain averages of the last ``n`` gains and losses; 100 without losses."""
    gain, loss = _over(F.avg("_gain"), "_gain", n), _over(F.avg("_loss"), "_loss", n)
    return F.when(loss == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + gain / loss))


def atr(n: int) -> Column:
    """I4: plain mean of the true range; the first is high less low."""
    return _over(F.avg("_range"), "_range", n)


def bollinger(n: int, k: float) -> dict[str, Column]:
    """Bands at ``k`` population deviations; bandwidth in percent of the middle."""
    mid, sd = sma(n), _over(F.stddev_pop("close"), "close", n)
    return {"bb_mid": mid, "bb_upper": mid + k * sd, "bb_lower": mid - k * sd, "bb_width": F.when(mid != 0, 2 * k * sd / mid * 100.0)}


def vwap() -> Column:
    """Running price by volume on the typical price."""
    w = Window.partitionBy(*BY).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("volume").over(w)
    return F.when(total > 0, F.sum((F.col("high") + F.col("low") + F.col("close")) / 3.0 * F.col("volume")).over(w) / total)
