"""Structured Streaming: minute aggregates, final and provisional bars, redelivery, watchdog, document pipeline, upsert sink.

Event time is TIMESTAMP (``withWatermark`` refuses TIMESTAMP_NTZ). ``append`` gives final bars, ``update`` provisional ones.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from strandline.sources.snapshots import SnapshotTable, Store

TRADE_SCHEMA = "time timestamp, symbol string, exchange string, trade_id string, price double, size double, side string"


def read_lane(spark: SparkSession, path: str, schema: str = TRADE_SCHEMA, channel: str | None = None, files_a_trigger: int | None = None, since: Column | str | None = None) -> DataFrame:
    """IO8: a stream of raw envelopes from files; a channel is a filter on its tag.

    Without ``since`` the lane replays all there is. With it (a time, or ``lane_start`` for a live lane) it starts with the
    envelopes published then: the bound reaches the scan, which skips what is older.
    """
    reader = spark.readStream.schema(schema)
    if files_a_trigger:
        reader = reader.option("maxFilesPerTrigger", files_a_trigger)
    df = reader.parquet(path)
    if since is not None:
        df = df.filter(F.col("published_at") >= (F.lit(since).cast("timestamp") if isinstance(since, str) else since))
    return df if channel is None else df.filter(F.col("channel") == channel)


def lane_start(spark: SparkSession, checkpoint: str, now: dt.datetime) -> str:
    """The start of a live lane: ``now`` at its first start, then the same however often it is started again."""
    store, text = Store(spark, checkpoint), now.astimezone(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f+00:00")
    store.create("lane-start", text)
    return store.read("lane-start") or text


def once(trades: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """ST5: each trade once, however often it is delivered within the watermark."""
    return trades.withWatermark("time", delay).dropDuplicatesWithinWatermark(["trade_id", "exchange", "symbol"])


def minute_trades(trades: DataFrame, width: str = "1 minute", delay: str = "3 minutes") -> DataFrame:
    """ST1, ST2: one-minute trade statistics; state per (minute, symbol, exchange) until the watermark passes."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("size")).otherwise(0.0))
    g = trades.withWatermark("time", delay).groupBy(F.window("time", width).alias("w"), "symbol", "exchange").agg(
        F.sum("size").alias("trade_volume"), side("buy").alias("buy_volume"), side("sell").alias("sell_volume"), F.count("*").alias("trade_count"), F.sum(F.col("price") * F.col("size")).alias("trade_notional"), F.max("time").alias("last_event_time"),
    )
    return g.select(F.col("w.start").alias("time"), "symbol", "exchange", "trade_volume", "buy_volume", "sell_volume", "trade_count", "trade_notional", "last_event_time")


_BOOK_STATE = "event_time timestamp, received_at timestamp, best_bid double, best_ask double, mid_price double, samples long"
_BOOK_ROW = "time timestamp, symbol string, exchange string, best_bid double, best_ask double, mid_price double, orderbook_samples long, last_event_time timestamp, is_final boolean"


class _MinuteBook(StatefulProcessor):
    """The newest book of a (symbol, exchange, minute) and how many there were, until the watermark passes the minute."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.book = handle, handle.getValueState("book", _BOOK_STATE)

    def _row(self, key: tuple, state: tuple, final: bool) -> pd.DataFrame:
        return pd.DataFrame([(key[2], key[0], key[1], state[2], state[3], state[4], state[5], state[0], final)], columns=[c.split()[0] for c in _BOOK_ROW.split(", ")])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.book.get() if self.book.exists() else None
        if state is None:  # due when no row of the minute can pass the watermark any more
            self.handle.registerTimer(int(pd.Timestamp(key[2]).timestamp() * 1000) + 60_000)
        for part in rows:
            # By event time, then arrival, then the book itself: the same whatever the order in which they come.
            part = part.sort_values(["event_time", "received_at", "best_bid", "best_ask", "mid_price"], na_position="first")
            newest = tuple(part.iloc[-1][["event_time", "received_at", "best_bid", "best_ask", "mid_price"]])
            samples = len(part) + (state[5] if state else 0)
            if state is None or _book_order(newest) >= _book_order(state[:5]):
                state = (*newest, samples)
            else:
                state = (*state[:5], samples)
        self.book.update(state)
        yield self._row(key, state, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.book.get()
        self.book.clear()
        yield self._row(key, state, True)

    def close(self) -> None:
        pass


def _book_order(x: tuple) -> tuple:
    return tuple((v is not None and not pd.isna(v), pd.Timestamp(v).value if k < 2 and v is not None and not pd.isna(v) else 0 if v is None or pd.isna(v) else v) for k, v in enumerate(x))


def minute_books(books: DataFrame, delay: str = "3 minutes") -> DataFrame:
    """ST1, ST4: the newest book of each minute by event time, whatever the order of arrival, and the number of books.

    One row each time that a micro-batch changes a minute (``is_final`` false), and one when the watermark has passed it,
    after which its state is gone. At equal event times the book received last counts. ``books`` has time, received_at,
    symbol, exchange, best_bid, best_ask and mid_price. Needs the RocksDB state store (``use_rocksdb``).
    """
    minute = F.date_trunc("minute", "time").alias("minute")
    rows = books.withWatermark("time", delay).select("symbol", "exchange", minute, F.col("time").alias("event_time"), "received_at", "best_bid", "best_ask", "mid_price")
    return rows.groupBy("symbol", "exchange", "minute").transformWithStateInPandas(_MinuteBook(), outputStructType=_BOOK_ROW, outputMode="Update", timeMode="EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that ``minute_books`` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def watchdog(bars: DataFrame, allowed_seconds: int) -> DataFrame:
    """ST7: one row when a (symbol, interval) hasn't had a bar for ``allowed_seconds`` of event time, one when it is back."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, stale = state.get if state.exists else (0, False)
        row = lambda what: pd.DataFrame([(key[0], last, what)], columns=["symbol", "last_seconds", "event"])
        if state.hasTimedOut:
            state.update((last, True))
            yield row("STALE")
            return
        for pdf in batches:
            last = max(last, int(pdf["seconds"].max()))
        if stale:
            yield row("RECOVERED")
        state.update((last, False))
        state.setTimeoutTimestamp(max((last + allowed_seconds) * 1000, state.getCurrentWatermarkMs() + 1))

    keyed = bars.withWatermark("time", "0 seconds").select("symbol", "time", F.unix_timestamp("time").alias("seconds"))
    return keyed.groupBy("symbol").applyInPandasWithState(run, "symbol string, last_seconds long, event string", "last long, stale boolean", "append", "EventTimeTimeout")


def document_pipeline(docs: DataFrame, steps: list[Callable[[DataFrame], DataFrame]], good: str) -> tuple[DataFrame, DataFrame]:
    """ST9: a chain of steps, split into rows that satisfy ``good`` and the others."""
    for step in steps:
        docs = step(docs)
    return docs.filter(good), docs.filter(f"NOT coalesce({good}, false)")


def upsert_sink(df: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """IO9: micro-batches handed to a keyed merge; a batch seen twice must leave the same table (``snapshot_sink`` sees to it)."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()


def snapshot_sink(df: DataFrame, table: SnapshotTable, writer: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """IO9: micro-batches upserted into a snapshot table, each once, also if it is run again after a crash."""
    return upsert_sink(df, lambda rows, batch: table.upsert(rows, writer, batch) and None, checkpoint, mode)


def drain(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there and return its rows (tests and batch-stream comparisons)."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return df.sparkSession.table(name)
