"""The data model on the given tables: trades, books, context, staging, runs, costs and vectors as typed frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEYS = ["time", "symbol", "exchange"]

TRADES = """
SELECT CAST(ts AS TIMESTAMP) AS time, event_type AS symbol, 'ex' || CAST(user_id % 2 AS STRING) AS exchange,
       CAST(event_id AS STRING) AS trade_id, value AS price, CAST(1 + event_id % 10 AS DOUBLE) AS size,
       CASE WHEN event_id % 3 = 0 THEN 'sell' ELSE 'buy' END AS side
FROM {events}"""
BOOKS = """
SELECT CAST(ts AS TIMESTAMP) AS time, event_type AS symbol, 'ex' || CAST(user_id % 2 AS STRING) AS exchange,
       value * 0.999 AS best_bid, value * 1.001 AS best_ask, value * 0.002 AS spread, CAST(0.2 AS DOUBLE) AS spread_pct,
       value AS mid_price, CAST(5 + event_id % 7 AS DOUBLE) AS bid_depth_10, CAST(5 + event_id % 11 AS DOUBLE) AS ask_depth_10
FROM {events} WHERE event_id % 4 <> 0"""
CONTEXT = """
SELECT CAST(ts AS TIMESTAMP) AS time, event_type AS symbol, 'ex' || CAST(user_id % 2 AS STRING) AS exchange,
       (CAST(event_id % 21 AS DOUBLE) - 10) / 10000 AS funding_rate, CAST(1000 + event_id % 500 AS DOUBLE) AS open_interest
FROM {events} WHERE event_id % 5 = 0"""
SENTIMENT = """
SELECT CAST(ts AS TIMESTAMP) AS observed_at, event_type AS symbol, 'feed' || CAST(user_id % 3 AS STRING) AS source,
       (CAST(event_id % 201 AS DOUBLE) - 100) / 100 AS sentiment_score, CAST(event_id % 11 AS DOUBLE) / 10 AS confidence
FROM {events} WHERE event_id % 7 = 0"""
STAGING = """
SELECT CAST(doc_id AS STRING) AS id, source, lang AS collection, text,
       CASE WHEN doc_id % 10 = 9 THEN 'FAILED' WHEN doc_id % 10 = 8 THEN 'PENDING' ELSE 'COMPLETED' END AS embedding_status
FROM {documents}"""
RUNS = """
SELECT CAST(o_orderdate AS TIMESTAMP) AS run_at, o_orderpriority AS strategy_name, o_orderstatus AS symbol, CAST(o_orderkey % 40 AS INT) AS trades,
       (o_totalprice / 100000.0) - 1.0 AS net_return_pct, CAST(o_custkey % 30 AS DOUBLE) AS max_drawdown_pct, o_orderkey AS run_id
FROM {orders}"""
COSTS = """
SELECT CAST(l_shipdate AS TIMESTAMP) AS observed_at, l_returnflag AS strategy_name, l_linestatus AS exchange, CAST(l_suppkey % 20 AS STRING) AS symbol,
       CASE WHEN l_linenumber % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, 'tier' || CAST(l_linenumber % 3 AS STRING) AS fee_tier,
       l_discount * 100 AS slippage_bps, l_tax * 100 AS fee_bps, (l_discount + l_tax) * 100 AS total_cost_bps,
       l_extendedprice AS notional_usd, l_quantity AS requested, l_orderkey AS order_key
FROM {lineitem}"""
VECTORS = "SELECT CAST(vec_id AS STRING) AS id, CAST(label AS STRING) AS collection, embedding FROM {embeddings}"

ADAPTERS = {"trades": TRADES, "books": BOOKS, "context": CONTEXT, "sentiment": SENTIMENT, "staging": STAGING, "runs": RUNS, "costs": COSTS, "vectors": VECTORS}
SOURCE_OF = {"trades": "events", "books": "events", "context": "events", "sentiment": "events", "staging": "documents", "runs": "orders", "costs": "lineitem", "vectors": "embeddings"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the adapters over its given table. Filters and columns reach the Parquet scan."""
    source = SOURCE_OF[name]
    return spark.sql(ADAPTERS[name].replace(f"{{{source}}}", "{source}"), source=table(spark, sf_dir, source))
