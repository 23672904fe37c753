"""Frames and SQL fragments that the registered queries share."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import bars as B
from strandline.operators import features as X
from strandline.operators import state as S
from strandline.sources.tables import ADAPTERS, KEYS, SOURCE_OF, load, table

AS_OF_TEXT = "2024-01-31 00:00:00"
START_TEXT = "2024-01-01 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF_TEXT).cast("timestamp")


def start() -> Column:
    return F.lit(START_TEXT).cast("timestamp")


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[r(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema])


class Market:
    """The market frames over one directory of tables; all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in ADAPTERS:
            return load(self.spark, self.dir, name)
        raise AttributeError(name)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @cached_property
    def candles_5m(self) -> DataFrame:
        return B.candles(self.trades, "5 minutes")

    @cached_property
    def candles_1h(self) -> DataFrame:
        return B.candles(self.trades, "1 hour")

    @cached_property
    def candles_4h(self) -> DataFrame:
        return B.candles(self.trades, "4 hours")

    @cached_property
    def daily_bars(self) -> DataFrame:
        """Daily candles of each symbol over both venues, with carry."""
        ohlc = B.candles(self.trades.withColumn("exchange", F.lit("all")), "4 hours").drop("exchange")
        context = self.context.groupBy(B.bucket("time", "4 hours").alias("time"), "symbol").agg(F.avg("funding_rate").alias("funding_rate"), F.avg("open_interest").alias("open_interest"))
        book = self.books.groupBy(B.bucket("time", "4 hours").alias("time"), "symbol").agg(F.avg(F.try_divide("spread", "mid_price") * 10_000).alias("spread_bps"), F.avg((F.col("bid_depth_10") + F.col("ask_depth_10")) / 2.0 * F.col("mid_price")).alias("depth_usd"))
        return ohlc.join(context, ["time", "symbol"], "left").join(book, ["time", "symbol"], "left")

    @cached_property
    def grid(self) -> DataFrame:
        return X.panel_grid(self.daily_bars)

    @cached_property
    def bars_5m(self) -> DataFrame:
        return B.bars_5m(self.candles_5m, B.minute_trades(self.trades), B.minute_books(self.books), B.minute_context(self.context), as_of())

    @cached_property
    def panel_daily(self) -> DataFrame:
        return B.panel_daily(self.candles_4h, self.bars_5m, self.context, self.context, as_of())

    @cached_property
    def channels(self) -> dict[str, DataFrame]:
        return {"candle_5m": self.candles_5m, "trade": self.trades, "orderbook_l2": self.books, "funding": self.context, "open_interest": self.context}

    @cached_property
    def sync(self) -> DataFrame:
        return S.sync_state(self.channels)


# ---- the same frames for the check, in DuckDB's SQL -------------------------------------------------

_OHLC = "arg_min(price, time) AS open, max(price) AS high, min(price) AS low, arg_max(price, time) AS close, sum(size) AS volume, count(*) AS num_trades"
_K = "time, symbol, exchange"


def _candles(width: str, source: str = "trades", where: str = "TRUE", keys: str = "symbol, exchange") -> str:
    return f"SELECT time_bucket(INTERVAL '{width}', time) AS time, {keys}, {_OHLC} FROM (SELECT * FROM {source} WHERE {where}) GROUP BY ALL"


_FINAL = "time + INTERVAL {w} + INTERVAL 3 MINUTE <= TIMESTAMP '" + AS_OF_TEXT + "'"

CTES: dict[str, str] = {name: sql.replace(f"{{{SOURCE_OF[name]}}}", SOURCE_OF[name]) for name, sql in ADAPTERS.items()} | {
    "m1t": f"SELECT time_bucket(INTERVAL '1 minute', time) AS time, symbol, exchange, sum(size) AS trade_volume, coalesce(sum(size) FILTER (WHERE side = 'buy'), 0.0) AS buy_volume, coalesce(sum(size) FILTER (WHERE side = 'sell'), 0.0) AS sell_volume, count(*) AS trade_count, sum(price * size) AS trade_notional, max(time) AS last_event_time FROM trades GROUP BY ALL",
    "m1b": f"SELECT time_bucket(INTERVAL '1 minute', time) AS time, symbol, exchange, {', '.join(f'arg_max({c}, time) AS {c}' for c in B.BOOK)}, count(*) AS orderbook_samples, max(time) AS last_event_time FROM books GROUP BY ALL".replace("time_bucket(INTERVAL '1 minute', time) AS time", "time_bucket(INTERVAL '1 minute', books.time) AS time").replace(", time) AS", ", books.time) AS").replace("max(time)", "max(books.time)").replace("GROUP BY ALL", "GROUP BY 1, 2, 3"),
    "m1c": "SELECT time_bucket(INTERVAL '1 minute', c.time) AS time, symbol, exchange, arg_max(funding_rate, c.time) AS funding_rate, arg_max(open_interest, c.time) AS open_interest, max(c.time) AS last_event_time FROM context c GROUP BY 1, 2, 3",
    "c5": _candles("5 minutes"),
    "c1h": _candles("1 hour"),
    "c4h": _candles("4 hours"),
    "b5t": "SELECT time_bucket(INTERVAL '5 minutes', x.time) AS time, symbol, exchange, sum(trade_volume) AS trade_volume, sum(buy_volume) AS buy_volume, sum(sell_volume) AS sell_volume, CAST(sum(trade_count) AS BIGINT) AS trade_count, CASE WHEN sum(trade_volume) > 0 THEN sum(trade_notional) / sum(trade_volume) END AS trade_vwap FROM m1t x GROUP BY 1, 2, 3",
    "b5b": f"SELECT time_bucket(INTERVAL '5 minutes', x.time) AS time, symbol, exchange, {', '.join(f'avg({c}) AS {c}' for c in B.BOOK)}, CAST(sum(orderbook_samples) AS BIGINT) AS orderbook_samples FROM m1b x GROUP BY 1, 2, 3",
    "b5c": "SELECT time_bucket(INTERVAL '5 minutes', x.time) AS time, symbol, exchange, avg(funding_rate) AS funding_rate, avg(open_interest) AS open_interest, count(*) AS n FROM m1c x GROUP BY 1, 2, 3",
    "b5": f"""SELECT k.time, k.symbol, k.exchange, {', '.join(f'coalesce(c.{p}, t.trade_vwap, nullif(o.mid_price, 0), o.best_bid, o.best_ask) AS {p}' for p in ('open', 'high', 'low', 'close'))},
        coalesce(c.volume, t.trade_volume, 0.0) AS volume, coalesce(c.num_trades, t.trade_count, 0) AS num_trades, coalesce(t.trade_volume, 0.0) AS trade_volume, coalesce(t.buy_volume, 0.0) AS buy_volume, coalesce(t.sell_volume, 0.0) AS sell_volume, coalesce(t.trade_count, 0) AS trade_count, t.trade_vwap,
        o.best_bid, o.best_ask, o.spread, o.spread_pct, coalesce(nullif(o.mid_price, 0), c.close) AS mid_price, coalesce(o.bid_depth_10, 0.0) AS bid_depth_10, coalesce(o.ask_depth_10, 0.0) AS ask_depth_10, coalesce(o.orderbook_samples, 0) AS orderbook_samples, a.funding_rate, a.open_interest,
        c.time IS NOT NULL AS candle_observed, t.time IS NOT NULL AS trade_observed, o.time IS NOT NULL AS orderbook_observed, coalesce(a.n, 0) > 0 AS asset_context_observed,
        NOT (k.{_FINAL.format(w='5 MINUTE')}) AS is_provisional, k.{_FINAL.format(w='5 MINUTE')} AS is_finalized, k.time + INTERVAL 8 MINUTE AS finalization_due_at, CASE WHEN k.{_FINAL.format(w='5 MINUTE')} THEN TIMESTAMP '{AS_OF_TEXT}' END AS finalized_at
        FROM (SELECT {_K} FROM c5 UNION SELECT {_K} FROM b5t UNION SELECT {_K} FROM b5b) k LEFT JOIN c5 c USING ({_K}) LEFT JOIN b5t t USING ({_K}) LEFT JOIN b5b o USING ({_K}) LEFT JOIN b5c a USING ({_K})""",
    "ohlc_all": f"SELECT time_bucket(INTERVAL '4 hours', t.time) AS time, symbol, {_OHLC.replace(', time)', ', t.time)')} FROM trades t GROUP BY 1, 2",
    "db": """SELECT o.*, c.funding_rate, c.open_interest, b.spread_bps, b.depth_usd FROM ohlc_all o
        LEFT JOIN (SELECT time_bucket(INTERVAL '4 hours', x.time) AS time, symbol, avg(funding_rate) AS funding_rate, avg(open_interest) AS open_interest FROM context x GROUP BY 1, 2) c USING (time, symbol)
        LEFT JOIN (SELECT time_bucket(INTERVAL '4 hours', x.time) AS time, symbol, avg(spread / nullif(mid_price, 0) * 10000) AS spread_bps, avg((bid_depth_10 + ask_depth_10) / 2.0 * mid_price) AS depth_usd FROM books x GROUP BY 1, 2) b USING (time, symbol)""",
    "grid": "SELECT g.time, s.symbol, db.* EXCLUDE (time, symbol) FROM (SELECT DISTINCT time FROM db) g CROSS JOIN (SELECT DISTINCT symbol FROM db) s LEFT JOIN db ON db.time = g.time AND db.symbol = s.symbol",
    "gr": "SELECT *, CASE WHEN close > 0 AND lag(close) OVER (PARTITION BY symbol ORDER BY time) > 0 THEN ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY time)) END AS r FROM grid",
    "sync": " UNION ALL ".join(f"SELECT exchange, symbol, '{c}' AS channel, min(time) AS earliest_raw_time, max(time) AS latest_raw_time, count(*) AS row_count FROM {t} GROUP BY exchange, symbol" for c, t in (("candle_5m", "c5"), ("trade", "trades"), ("orderbook_l2", "books"), ("funding", "context"), ("open_interest", "context"))),
}
NEEDS = {
    "m1t": ["trades"], "m1b": ["books"], "m1c": ["context"], "c5": ["trades"], "c1h": ["trades"], "c4h": ["trades"], "b5t": ["m1t"], "b5b": ["m1b"], "b5c": ["m1c"], "b5": ["c5", "b5t", "b5b", "b5c"],
    "ohlc_all": ["trades"], "db": ["ohlc_all", "context", "books"], "grid": ["db"], "gr": ["grid"], "sync": ["c5", "trades", "books", "context"],
}


def sql(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``body`` after a WITH clause of the named fragments, what they need, and ``extra``."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def rr(*columns: str, digits: int = 6) -> str:
    """``round(c, 6) + 0.0 AS c`` of each; ``expression AS name`` is taken apart."""
    out = []
    for c in columns:
        expression, _, name = c.rpartition(" AS ")
        out.append(f"round({expression or name}, {digits}) + 0.0 AS {name}")
    return ", ".join(out)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(market) -> DataFrame`` under ``name`` with its DuckDB SQL."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Market(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def keys(df: DataFrame) -> list[str]:
    return KEYS
