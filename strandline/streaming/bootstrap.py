"""ST6: minute tables filled from history and carried on by a stream, each trade counted once.

History is taken in chunks, newest first, up to some minutes before now; the stream starts from a time before that, so
that the two overlap and nothing falls between. Trades are kept as they are, one row a key, in a snapshot table: a trade
that both bring, or that is delivered again, is one row. Minutes are always computed from all kept trades of the days that
a chunk or micro-batch touches, so that late rows count where they belong, and put in place of the old ones. Chunks and
micro-batches have numbers in the tables' ledgers: a bootstrap or a stream that is started again goes on where it was.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from strandline.operators import bars
from strandline.sources.snapshots import SnapshotTable

TRADE_KEYS = ["time", "symbol", "exchange", "trade_id"]
TRADES = "time timestamp, symbol string, exchange string, trade_id string, price double, size double, side string"
MINUTE_KEYS = ["time", "symbol", "exchange"]
MINUTES = "time timestamp, symbol string, exchange string, trade_volume double, buy_volume double, sell_volume double, trade_count long, trade_notional double, last_event_time timestamp"


def columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def chunks(now: dt.datetime, hours: int, chunk_minutes: int, overlap_minutes: int = 5) -> list[tuple[dt.datetime, dt.datetime]]:
    """[start, end) windows, newest first, over ``hours`` up to the whole minute ``overlap_minutes`` before ``now``."""
    end = now.replace(second=0, microsecond=0) - dt.timedelta(minutes=max(overlap_minutes, 0))
    first, out = end - dt.timedelta(hours=hours), []
    while end > first:
        start = max(first, end - dt.timedelta(minutes=max(chunk_minutes, 1)))
        out.append((start, end))
        end = start
    return out


@dataclass
class MinuteTables:
    """The kept trades and the minutes computed from them, under one folder."""

    spark: SparkSession
    root: str

    def __post_init__(self) -> None:
        firsts = {c: "first" for c in columns(TRADES) if c not in TRADE_KEYS}
        self.trades = SnapshotTable(self.spark, f"{self.root}/trades", TRADES, TRADE_KEYS, firsts)
        self.minutes = SnapshotTable(self.spark, f"{self.root}/minutes", MINUTES, MINUTE_KEYS, {c: "replace" for c in columns(MINUTES) if c not in MINUTE_KEYS})

    def add(self, rows: DataFrame, writer: str, batch: int) -> None:
        """Keep the trades of a batch, then compute the minutes of the days that it touches. Both steps can be repeated."""
        rows = rows.select(*columns(TRADES)).dropDuplicates(TRADE_KEYS).persist()
        try:
            self.trades.upsert(rows, writer, batch)
            days = [r[0] for r in rows.select(F.coalesce(F.expr(self.trades.part), F.lit("none"))).distinct().collect()]
            touched = rows.select(F.date_trunc("minute", "time").alias("time"), "symbol", "exchange").distinct()
            kept = bars.minute_trades(self.trades.read(days)).select(*columns(MINUTES))
            self.minutes.upsert(kept.join(touched, MINUTE_KEYS, "left_semi"), writer, batch)
        finally:
            rows.unpersist()


def bootstrap(tables: MinuteTables, history: DataFrame, now: dt.datetime, hours: int, chunk_minutes: int, overlap_minutes: int = 5) -> int:
    """Fill the tables from ``history``, newest chunk first; the chunks that are there already are left out. Returns their number.

    A run that was broken off goes on with the same ``now``; the name of the writer has it, so another run is another writer.
    """
    windows = chunks(now, hours, chunk_minutes, overlap_minutes)
    writer = f"bootstrap-{now.isoformat()}"
    done = tables.minutes.version()["batches"].get(writer, -1)
    for k, (start, end) in enumerate(windows):
        if k > done:
            tables.add(history.filter((F.col("time") >= F.lit(start)) & (F.col("time") < F.lit(end))), writer, k)
    return len(windows)


def go_on(tables: MinuteTables, live: DataFrame, checkpoint: str, writer: str = "live") -> StreamingQuery:
    """The stream ``live`` of trades (``stream.read_lane`` from a time before the bootstrap's end) into the same tables."""
    return live.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, batch: tables.add(rows, writer, batch)).start()
