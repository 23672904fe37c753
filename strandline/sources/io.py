"""Readers and sinks. Paths are any that Spark can open; nothing is fetched over a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.docs import flatten_vulnerability
from strandline.operators.state import insert_ignore, merge
from strandline.sources.snapshots import SnapshotTable

# ---- reads of the market tables --------------------------------------------------------------------


def scan(df: DataFrame, start: Column, end: Column, **equal: str) -> DataFrame:
    """IO1: [start, end) and equalities; with Parquet both reach the scan."""
    out = df.filter((F.col("time") >= start) & (F.col("time") < end))
    for name, value in equal.items():
        out = out.filter(F.col(name) == value)
    return out


def newest(df: DataFrame, symbol: str, start: Column, end: Column, limit: int) -> DataFrame:
    """IO2, IO3: rows of a symbol in [start, end], newest first; a page of ``limit``."""
    return df.filter((F.col("symbol") == symbol) & (F.col("time") >= start) & (F.col("time") <= end)).orderBy(F.desc("time")).limit(limit)


def side_of(raw: Column) -> Column:
    """IO3: ``buy`` or ``b`` in any case is a buy, all else a sell."""
    return F.when(F.lower(raw).isin("buy", "b"), "buy").otherwise("sell")


def latest(df: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """IO4, W2: the newest row of each key, by one aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), time).alias("_l")).select(*keys, "_l.*")


def newer_of(minute: DataFrame, raw: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """IO5, IO6: the newer of the minute state (by its last event) and the raw rows; the minute state on ties."""
    m = minute.select(*keys, F.coalesce("last_event_time", "time").alias("time"), *columns, F.lit(1).alias("_p"))
    r = raw.select(*keys, "time", *columns, F.lit(0).alias("_p"))
    w = Window.partitionBy(*keys).orderBy(F.desc("time"), F.desc("_p"))
    return m.union(r).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_p")


def current_books(minute: DataFrame, raw: DataFrame, legacy: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """IO5: the newer of minute state and raw book; for keys that neither has, the newest row of the legacy table.

    ``legacy`` names its sides ``bid_price`` and ``ask_price``; what else it lacks of ``columns`` is null, the middle and the
    spread are computed.
    """
    known = newer_of(minute, raw, keys, columns)
    old = latest(legacy.select(*keys, "time", "bid_price", "ask_price"), keys)
    bid, ask = F.col("bid_price"), F.col("ask_price")
    made = {"best_bid": bid, "best_ask": ask, "mid_price": (bid + ask) / 2.0, "spread": ask - bid}
    rest = old.select(*keys, "time", *[made.get(c, F.lit(None)).cast(known.schema[c].dataType).alias(c) for c in columns])
    return known.select(*keys, "time", *columns).unionByName(rest.join(known.select(*keys), keys, "left_anti"))


def latest_candidates(df: DataFrame, aliases: list[str], everywhere: str, since: Column, time: str) -> DataFrame:
    """IO7: the newest row over a symbol's aliases and a global symbol within the lookback."""
    return latest(df.filter(F.col("symbol").isin(*aliases, everywhere) & (F.col(time) >= since)).withColumn("_one", F.lit(1)), ["_one"], time).drop("_one")


# ---- document sources ------------------------------------------------------------------------------


def read_torrents(spark: SparkSession, path: str) -> DataFrame:
    """IO11: infohash, name, size, created, seeders, leechers and completed, with commas and quotes; fewer than three fields are dropped, missing numbers are 0 or null."""
    names = ["infohash", "name", "size_bytes", "created", "seeders", "leechers", "completed"]
    raw = spark.read.option("sep", ",").option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").schema(", ".join(f"{n} string" for n in names)).csv(path)
    number = lambda c, kind, otherwise: F.coalesce(F.expr(f"try_cast({c} AS {kind})"), F.lit(otherwise)) if otherwise is not None else F.expr(f"try_cast({c} AS {kind})")
    kept = raw.filter("infohash IS NOT NULL AND name IS NOT NULL AND size_bytes IS NOT NULL")
    return kept.select("infohash", "name", number("size_bytes", "BIGINT", 0).alias("size_bytes"), number("created", "BIGINT", None).alias("created"), *[number(c, "INT", 0).alias(c) for c in names[4:]])


def read_legal(spark: SparkSession, path: str, jurisdictions: list[str], types: list[str], least: int = 100) -> DataFrame:
    """IO12: lists and a minimum length over Parquet; the lists are pushed to the scan. Empty lists keep all."""
    df = spark.read.parquet(path)
    for name, values in (("jurisdiction", jurisdictions), ("type", types)):
        if values:
            df = df.filter(F.col(name).isin(*values))
    return df.filter(F.length("text") >= least)


def read_vulnerabilities(spark: SparkSession, path: str) -> DataFrame:
    """IO13: a file of one JSON record a line, flattened."""
    return flatten_vulnerability(spark.read.text(path).withColumnRenamed("value", "json"))


def read_wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """IO14: pages of an XML dump in the main namespace, without redirects and empty ones."""
    schema = "title string, ns long, id long, redirect struct<_title:string>, revision struct<timestamp:string, text:struct<_VALUE:string>>"
    df = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    text = F.col("revision.text._VALUE")
    return df.filter((F.col("ns") == 0) & F.col("redirect").isNull() & (F.coalesce(F.trim(text), F.lit("")) != "")).select("id", "title", F.col("revision.timestamp").alias("timestamp"), text.alias("text"))


def read_text_tree(spark: SparkSession, path: str, pattern: str = "*.{txt,rst,md,asciidoc}") -> DataFrame:
    """IO15: whole text files under a folder, with their path."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """IO16: items of feed files with their categories as an array."""
    schema = "title string, link string, guid string, pubDate string, description string, category array<string>"
    df = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return df.select(F.coalesce("guid", "link").alias("id"), "title", "link", F.col("pubDate").alias("published"), "description", F.coalesce("category", F.array().cast("array<string>")).alias("categories"))


def render_feed_item(title: Column, link: Column, published: Column, categories: Column, body: Column) -> Column:
    """a feed item as text."""
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", F.concat(F.lit("# "), title), line("Link", link), line("Published", published), line("Categories", F.array_join(categories, ", ")), F.lit(""), body)


# ---- sinks -----------------------------------------------------------------------------------------


def write_table(df: DataFrame, path: str, date: str = "time") -> None:
    """Market tables: one folder a day, each file in (symbol, time) order."""
    out = df.withColumn("date", F.to_date(date))
    out.repartition("date", "symbol").sortWithinPartitions("date", "symbol", date).write.mode("append").partitionBy("date").parquet(path)


def upsert_path(spark: SparkSession, base: str, target: str, delta: DataFrame, keys: list[str], rules: dict[str, str]) -> None:
    """K1 on files: merge into a new path; the caller switches to it."""
    merge(spark.read.parquet(base), delta, keys, rules).write.mode("overwrite").parquet(target)


def append_new(spark: SparkSession, path: str, delta: DataFrame, keys: list[str]) -> None:
    """IO10: append the rows whose key isn't there."""
    insert_ignore(spark.read.parquet(path), delta, keys).write.mode("append").parquet(path)


def run_tables(runs: DataFrame, arrays: list[str]) -> dict[str, DataFrame]:
    """IO17: a nested run result as a run table and one table for each of its arrays, ranked in order."""
    out = {"runs": runs.drop(*arrays)}
    for name in arrays:
        out[name] = runs.select("run_id", F.posexplode(name).alias("p", "x")).select("run_id", (F.col("p") + 1).alias("rank"), "x.*")
    return out


def replace_range(base: DataFrame, fresh: DataFrame, keys: list[str], time: str) -> DataFrame:
    """IO18: rows of each key inside the span of its new rows are replaced by them; run twice, the result is the same."""
    span = fresh.groupBy(*keys).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    kept = base.join(span, keys, "left").filter(F.col("_lo").isNull() | (F.col(time) < F.col("_lo")) | (F.col(time) > F.col("_hi"))).select(*base.columns)
    return kept.unionByName(fresh)


def vector_table(spark: SparkSession, root: str) -> SnapshotTable:
    """IO19: vectors of one row a (collection, point id), dealt by collection and the first digits of the id."""
    part = "concat(collection, '-', left(point_id, 2))"
    return SnapshotTable(spark, root, "collection string, point_id string, id string, embedding array<float>", ["collection", "point_id"], {"id": "replace", "embedding": "replace"}, part=part)


def upsert_vectors(table: SnapshotTable, df: DataFrame, writer: str, batch: int) -> bool:
    """IO19: put vectors in place of those with their id; of several rows of an id the last by ``df``'s own order of values stays.

    A batch that the table holds already changes nothing.
    """
    rows = df.select("collection", F.sha2("id", 256).alias("point_id"), "id", "embedding")
    one = rows.groupBy("collection", "point_id").agg(F.max(F.struct("embedding", "id")).alias("_x")).select("collection", "point_id", "_x.id", "_x.embedding")
    return table.upsert(one, writer, batch)


def write_vectors(df: DataFrame, path: str) -> None:
    """IO19: vectors under a deterministic id, one folder a collection."""
    df.withColumn("point_id", F.sha2("id", 256)).write.mode("append").partitionBy("collection").parquet(path)
