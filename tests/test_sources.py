"""Readers and sinks on small files."""

import datetime as dt

from pyspark.sql import functions as F

from strandline.sources import io


def test_text_readers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.md").write_text("# A\nx")
    (tmp_path / "d/b.bin").write_text("no")
    assert [r.text for r in io.read_text_tree(spark, str(tmp_path / "d")).collect()] == ["# A\nx"]
    (tmp_path / "t.csv").write_text('h1,"a, b",12,5,1,2,3\nh2,c,,x\nbad,row\n')
    rows = io.read_torrents(spark, str(tmp_path / "t.csv")).collect()
    assert [tuple(r) for r in rows] == [("h1", "a, b", 12, 5, 1, 2, 3)]


def test_xml_readers(spark, tmp_path):
    (tmp_path / "w.xml").write_text('<mediawiki><page><title>A</title><ns>0</ns><id>1</id><revision><timestamp>t</timestamp><text a="b">hello</text></revision></page><page><title>B</title><ns>1</ns><id>2</id><revision><text a="b">x</text></revision></page><page><title>R</title><ns>0</ns><id>3</id><redirect title="A"/><revision><text a="b">x</text></revision></page></mediawiki>')
    assert [(r.title, r.text) for r in io.read_wiki_dump(spark, str(tmp_path / "w.xml")).collect()] == [("A", "hello")]
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T</title><link>l</link><category>c1</category><category>c2</category></item><item><title>U</title><guid>g</guid></item></channel></rss>")
    assert {r.id: r.categories for r in io.read_feed(spark, str(tmp_path / "f.xml")).collect()} == {"l": ["c1", "c2"], "g": []}


def test_legal_and_vulnerabilities(spark, tmp_path):
    spark.createDataFrame([("nsw", "act", "x" * 100), ("vic", "act", "x" * 100), ("nsw", "act", "short")], "jurisdiction string, type string, text string").write.parquet(str(tmp_path / "l"))
    assert io.read_legal(spark, str(tmp_path / "l"), ["nsw"], []).count() == 1
    (tmp_path / "v.json").write_text('{"id":"CVE-2","descriptions":[],"metrics":{}}\n')
    assert io.read_vulnerabilities(spark, str(tmp_path / "v.json")).first().severity == "UNKNOWN"


def test_sinks(spark, tmp_path):
    t = lambda d: dt.datetime(2026, 1, d)
    base = spark.createDataFrame([("a", t(1), 1), ("a", t(2), 2), ("b", t(2), 3)], "k string, time timestamp, v int")
    fresh = spark.createDataFrame([("a", t(2), 20)], "k string, time timestamp, v int")
    once = io.replace_range(base, fresh, ["k"], "time")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, io.replace_range(once, fresh, ["k"], "time").collect()))
    io.write_table(base.withColumnRenamed("k", "symbol"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).filter("date = DATE '2026-01-02'").count() == 2
    base.write.parquet(str(tmp_path / "b"))
    io.append_new(spark, str(tmp_path / "b"), fresh.union(spark.createDataFrame([("c", t(3), 9)], fresh.schema)), ["k", "time"])
    assert spark.read.parquet(str(tmp_path / "b")).count() == 4
    io.upsert_path(spark, str(tmp_path / "b"), str(tmp_path / "b2"), fresh, ["k", "time"], {"v": "add"})
    assert spark.read.parquet(str(tmp_path / "b2")).filter("k = 'a' AND time = TIMESTAMP '2026-01-02'").first().v == 22
    runs = spark.createDataFrame([("r", [("x", 1.0), ("y", 2.0)])], "run_id string, signals array<struct<symbol:string,w:double>>")
    assert [(r.rank, r.symbol) for r in io.run_tables(runs, ["signals"])["signals"].orderBy("rank").collect()] == [(1, "x"), (2, "y")]
    io.write_vectors(spark.createDataFrame([("1", "c", [0.5])], "id string, collection string, embedding array<float>"), str(tmp_path / "q"))
    assert len(spark.read.parquet(str(tmp_path / "q")).first().point_id) == 64


def test_reads(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (3, "a", 3.0), (2, "b", 2.0)], "time int, symbol string, v double")
    assert {r.symbol: r.v for r in io.latest(df, ["symbol"]).collect()} == {"a": 3.0, "b": 2.0}
    assert [r[0] for r in spark.createDataFrame([("B",), ("buy",), ("x",)], "s string").select(io.side_of(F.col("s"))).collect()] == ["buy", "buy", "sell"]
    text = spark.range(1).select(io.render_feed_item(F.lit("T"), F.lit("l"), F.lit(None).cast("string"), F.array(F.lit("c")), F.lit("b"))).first()[0]
    assert text == "# T\nLink: l\nCategories: c\n\nb"


def test_vectors_are_replaced_by_id(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "id string, collection string, embedding array<float>")
    table = io.vector_table(spark, str(tmp_path / "v"))
    first, second = rows(("1", "c", [0.5]), ("2", "c", [1.0]), ("1", "d", [9.0])), rows(("1", "c", [2.0]), ("3", "c", [3.0]), ("3", "c", [3.0]))
    assert io.upsert_vectors(table, first, "w", 0) and io.upsert_vectors(table, second, "w", 1) and not io.upsert_vectors(table, first, "w", 1)
    assert sorted((r.collection, r.id, r.embedding) for r in table.read().collect()) == [("c", "1", [2.0]), ("c", "2", [1.0]), ("c", "3", [3.0]), ("d", "1", [9.0])]


def test_current_books_fall_back(spark):
    df = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n == 's' else 'long' if 'time' in n else 'double'}" for n in names.split()))
    minute, raw = df([("A", 1, 5, 1.0, 2.0)], "s time last_event_time best_bid spread"), df([("A", 4, 9.0, 9.0), ("B", 3, 3.0, 1.0)], "s time best_bid spread")
    legacy = df([("A", 99, 7.0, 8.0), ("C", 1, 1.0, 2.0), ("C", 2, 4.0, 6.5)], "s time bid_price ask_price")
    got = {r.s: (r.time, r.best_bid, r.spread) for r in io.current_books(minute, raw, legacy, ["s"], ["best_bid", "spread"]).collect()}
    assert got == {"A": (5, 1.0, 2.0), "B": (3, 3.0, 1.0), "C": (2, 4.0, 2.5)}
