"""Snapshot tables, lanes, stateful books and the hand-off from history to a stream: repeats, crashes, gaps and late rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import bars
from strandline.sources.snapshots import SnapshotTable
from strandline.streaming import bootstrap as B
from strandline.streaming import stream as ST

AT = dt.datetime(2024, 3, 1, 12, 0)
MINUTES = "time timestamp, symbol string, n long, top double, seen timestamp"


def table(spark, path, **more):
    return SnapshotTable(spark, str(path), MINUTES, ["time", "symbol"], {"n": "add", "top": "greatest", "seen": "latest"}, time="seen", **more)


def rows(spark, *items):
    return spark.createDataFrame([(AT + dt.timedelta(hours=h), s, n, top, AT + dt.timedelta(hours=seen)) for h, s, n, top, seen in items], MINUTES)


def held(t):
    return sorted((r.time, r.symbol, r.n, r.top, r.seen) for r in t.read().collect())


def test_a_batch_counts_once_and_a_crash_leaves_the_table(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert held(t) == []
    first, second = rows(spark, (0, "A", 1, 5.0, 0), (30, "B", 2, 1.0, 1)), rows(spark, (0, "A", 10, 3.0, 2), (31, "C", 1, 1.0, 1))
    assert t.upsert(first, "w", 0) and not t.upsert(first, "w", 0)
    before = held(t)

    def crash():
        raise RuntimeError("between write and switch")

    with pytest.raises(RuntimeError):
        t.upsert(second, "w", 1, before_switch=crash)
    assert held(t) == before and t.version()["batches"] == {"w": 0}
    assert t.upsert(second, "w", 1) and not t.upsert(second, "w", 1)
    hour = lambda h: AT + dt.timedelta(hours=h)
    want = sorted([(hour(0), "A", 11, 5.0, hour(2)), (hour(30), "B", 2, 1.0, hour(1)), (hour(31), "C", 1, 1.0, hour(1))])
    assert held(t) == want
    # Only the touched days are written anew; old versions can go.
    assert {p: f.split("/")[1][:12] for p, f in t.version()["parts"].items()} == {"20240301": "000000000002", "20240302": "000000000002"}
    t.vacuum(keep=1)
    assert held(t) == want and len(t.store.names("versions")) == 1 and len(t.store.names("data")) == 1


def test_two_writers_at_once(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    other = table(spark, tmp_path / "t")
    # While the first has written and not switched, the second becomes the next version; the first merges onto it.
    state = []

    def meanwhile():
        if not state:
            state.append(other.upsert(rows(spark, (0, "A", 5, 9.0, 9)), "other", 0))

    assert t.upsert(rows(spark, (0, "A", 1, 1.0, 1)), "w", 0, before_switch=meanwhile) and state == [True]
    assert held(t) == [(AT, "A", 6, 9.0, AT + dt.timedelta(hours=9))] and t.version()["batches"] == {"other": 0, "w": 0}


def test_snapshot_sink_restarts(spark, tmp_path):
    lane, t = str(tmp_path / "lane"), table(spark, tmp_path / "t")
    for k in range(3):
        rows(spark, (0, "A", 1, float(k), k)).coalesce(1).write.mode("append").parquet(lane)
        for _ in range(2):  # the second start finds nothing new
            ST.snapshot_sink(spark.readStream.schema(MINUTES).parquet(lane), t, "s", str(tmp_path / "c"), mode="append").awaitTermination()
    assert held(t) == [(AT, "A", 3, 2.0, AT + dt.timedelta(hours=2))]


def test_lanes(spark, tmp_path):
    lane, schema = str(tmp_path / "lane"), "published_at timestamp, channel string, body string"

    def publish(*items):
        spark.createDataFrame([(AT + dt.timedelta(minutes=m), c, b) for m, c, b in items], schema).coalesce(1).write.mode("append").parquet(lane)

    def bodies(name, **how):
        return sorted(r.body for r in ST.drain(ST.read_lane(spark, lane, schema, **how), name).collect())

    publish((0, "trade", "a"), (1, "book", "b"))
    publish((5, "trade", "c"))
    checkpoint, utc = str(tmp_path / "live"), AT.replace(tzinfo=dt.timezone.utc)
    start = ST.lane_start(spark, checkpoint, utc + dt.timedelta(minutes=5))
    publish((4, "trade", "late"), (6, "trade", "d"))
    assert ST.lane_start(spark, checkpoint, utc + dt.timedelta(hours=9)) == start  # a restart keeps the first start
    replay, live, older = bodies("l1"), bodies("l2", since=start), bodies("l3", since=f"{AT:%Y-%m-%d %H:%M:%S} UTC")
    assert replay == older == ["a", "b", "c", "d", "late"] and live == ["c", "d"]
    assert bodies("l4", channel="trade", since=start) == ["c", "d"] and bodies("l5", channel="book") == ["b"]
    before = ST.drain(ST.read_lane(spark, lane, schema).filter(F.col("published_at") < F.lit(start).cast("timestamp")), "l6")
    assert sorted([r.body for r in before.collect()] + live) == replay  # disjoint and complete


def test_books_out_of_order(spark, tmp_path):
    ST.use_rocksdb(spark)
    schema = "time timestamp, received_at timestamp, symbol string, exchange string, best_bid double, best_ask double, mid_price double"
    at = lambda s: AT + dt.timedelta(seconds=s)
    book = lambda s, got, mid, symbol="A": (at(s), at(got), symbol, "x", mid - 1, mid + 1, mid)
    batches = [
        [book(30, 31, 10.0), book(50, 51, 12.0), book(70, 71, 20.0)],
        [book(40, 80, 11.0), book(50, 81, 13.0), book(50, 51, 12.0), book(5, 82, 1.0, "B")],  # late, equal in time but received later, repeated
        [book(10, 90, 9.0), book(50, 60, 12.5), book(70, 71, 20.0)],
        [book(900, 900, 30.0)],
    ]
    path = str(tmp_path / "books")
    for k, items in enumerate(batches):
        spark.createDataFrame(items, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = ST.drain(ST.minute_books(stream), "books", "update", str(tmp_path / "c")).collect()
    final = {(r.symbol, r.time): (r.best_bid, r.best_ask, r.mid_price, r.orderbook_samples, r.last_event_time) for r in out if r.is_final}
    every = spark.read.parquet(path).filter(F.col("time") < F.lit(at(600)))
    want = every.groupBy("symbol", F.date_trunc("minute", "time").alias("minute")).agg(F.max(F.struct("time", "received_at", "best_bid", "best_ask", "mid_price")).alias("b"), F.count("*").alias("n"))
    assert final == {(r.symbol, r.minute): (r.b.best_bid, r.b.best_ask, r.b.mid_price, r.n, r.b.time) for r in want.collect()}
    assert final["A", AT][2:4] == (13.0, 7)
    assert [r.mid_price for r in out if not r.is_final and r.symbol == "A" and r.time == AT][-1] == 13.0


def test_chunks_are_newest_first_and_skip_the_overlap():
    now = dt.datetime(2024, 3, 1, 12, 0, 40)
    found = B.chunks(now, 2, 50)
    assert found[0] == (dt.datetime(2024, 3, 1, 11, 5), dt.datetime(2024, 3, 1, 11, 55)) and found[-1][0] == dt.datetime(2024, 3, 1, 9, 55)
    assert all(a[0] == b[1] for a, b in zip(found, found[1:])) and len(found) == 3 and B.chunks(now, 0, 50) == []


def test_bootstrap_and_stream_equal_one_batch(spark, tmp_path):
    rng = random.Random(5)
    trade = lambda k, s: (AT - dt.timedelta(seconds=s), "AB"[k % 2], "x", str(k), 100.0 + k % 7, 1.0 + k % 3, ("buy", "sell")[k % 3 == 0])
    every = [trade(k, rng.randrange(0, 4 * 3600)) for k in range(600)]
    missing = {r[3] for r in every if r[0] > AT - dt.timedelta(minutes=30) and int(r[3]) % 5 == 0}  # not yet in the history
    history = spark.createDataFrame([r for r in every if r[3] not in missing], B.TRADES)
    tables = B.MinuteTables(spark, str(tmp_path / "m"))
    real, calls = tables.minutes.upsert, []

    def broken(rows, writer, batch):
        calls.append(batch)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return real(rows, writer, batch)

    tables.minutes.upsert = broken
    with pytest.raises(RuntimeError):
        B.bootstrap(tables, history, AT, 3, 60)
    tables.minutes.upsert = real
    assert B.bootstrap(tables, history, AT, 3, 60) == 3 and calls == [0, 1, 2]
    # The stream starts 40 minutes back: an overlap with the history, the gap after it, late rows and redeliveries.
    lane = str(tmp_path / "lane")
    recent = [r for r in every if r[0] > AT - dt.timedelta(minutes=40)]
    rng.shuffle(recent)
    for part in (recent[: len(recent) // 2], recent[len(recent) // 3 :], recent[:5]):
        spark.createDataFrame(part, B.TRADES).coalesce(1).write.mode("append").parquet(lane)
        B.go_on(tables, spark.readStream.schema(B.TRADES).parquet(lane), str(tmp_path / "c")).awaitTermination()
    since = AT - dt.timedelta(hours=3, minutes=5)
    want = bars.minute_trades(spark.createDataFrame([r for r in every if r[0] >= since], B.TRADES)).select(*B.columns(B.MINUTES))
    assert sorted(map(tuple, tables.minutes.read().collect())) == sorted(map(tuple, want.collect()))
    assert tables.trades.read().count() == len([r for r in every if r[0] >= since])
