"""Streams against the batch forms of the same operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandline.operators import bars as B
from strandline.sources.tables import load
from strandline.streaming import stream as ST


@pytest.fixture(scope="module")
def lane(spark, data_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lane")) + "/trades"
    load(spark, data_dir, "trades").repartition(3).write.parquet(path)
    return path


def test_minute_trades_equal_batch(spark, lane, tmp_path):
    # A late far-future row closes all earlier minutes, so that append mode emits them.
    last = spark.createDataFrame([(dt.datetime(2030, 1, 1), "END", "x", "z", 1.0, 1.0, "buy")], ST.TRADE_SCHEMA)
    last.write.parquet(f"{lane}_end")
    last.write.mode("append").parquet(lane)
    got = ST.drain(ST.minute_trades(ST.read_lane(spark, lane), delay="40 days"), "m1").filter("symbol <> 'END'")
    want = B.minute_trades(spark.read.parquet(lane).filter("symbol <> 'END'"))
    key = ["time", "symbol", "exchange", "trade_count", "last_event_time"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def test_redelivered_trades_count_once(spark, lane):
    seen = ST.drain(ST.once(ST.read_lane(spark, lane).union(ST.read_lane(spark, lane)), "40 days"), "once")
    assert seen.count() == spark.read.parquet(lane).select("trade_id", "exchange", "symbol").distinct().count()


def test_watchdog(spark, tmp_path):
    path, at = str(tmp_path / "bars"), dt.datetime(2026, 1, 1)

    def push(*rows):
        spark.createDataFrame([(at + dt.timedelta(seconds=s), n) for n, s in rows], "time timestamp, symbol string").coalesce(1).write.mode("append").parquet(path)

    push(("A", 0), ("B", 0))
    push(("B", 400))
    push(("B", 800))
    push(("A", 801))
    df = spark.readStream.schema("time timestamp, symbol string").option("maxFilesPerTrigger", 1).parquet(path)
    events = [(r.symbol, r.event) for r in ST.drain(ST.watchdog(df, 300), "dog", checkpoint=str(tmp_path / "c")).collect()]
    assert ("A", "STALE") in events and ("A", "RECOVERED") in events


def test_upsert_sink_and_bad_rows(spark, lane, tmp_path):
    out = []
    q = ST.upsert_sink(ST.read_lane(spark, lane).groupBy("symbol").agg(F.count("*").alias("n")), lambda df, i: out.append({r.symbol: r.n for r in df.collect()}), str(tmp_path / "c"))
    q.awaitTermination()
    assert sum(out[-1].values()) == spark.read.parquet(lane).count()
    good, bad = ST.document_pipeline(spark.createDataFrame([("a", 1), (None, 2)], "id string, n int"), [lambda d: d.withColumn("n", F.col("n") * 2)], "id IS NOT NULL")
    assert (good.count(), bad.count()) == (1, 1)
