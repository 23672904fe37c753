"""Postings for full-text search: the terms of a collection kept once, so that a query reads its own terms only.

``build`` writes three tables under one path. ``postings`` has one row for each term of each document, with the term's
count and the document's length, in ``BUCKETS`` folders by the hash of the term and sorted by term inside a file; a query
prunes folders by hash and row groups by term. A common term's rows are spread over several files. ``terms`` has the
document frequency of each term, dealt alike, and ``totals`` the number of documents and their average length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64
#: Files that the rows of one bucket are spread over, so that a term in most documents isn't one task's.
SPREAD = 8
_POSTINGS = "term string, id string, collection string, tf int, len int, bucket int"


def tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}0-9_]+"), F.lit(0))


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build(docs: DataFrame, path: str) -> None:
    """Write the postings of the completed documents (id, collection, text); one pass over the texts.

    A document without a term counts for the totals only; its row has the empty term.
    """
    split = docs.filter("embedding_status = 'COMPLETED'").select("id", "collection", tokens("text").alias("_t"))
    each = split.select("id", "collection", F.size("_t").alias("len"), F.explode(F.when(F.size("_t") > 0, F.col("_t")).otherwise(F.array(F.lit("")))).alias("term"))
    counted = each.groupBy("id", "collection", "len", "term").agg(F.count("*").cast("int").alias("tf")).withColumn("bucket", bucket_of(F.col("term")))
    dealt = counted.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term")
    dealt.select("term", "id", "collection", "tf", "len", "bucket").write.partitionBy("bucket").parquet(f"{path}/postings")
    spark = docs.sparkSession
    held = spark.read.schema(_POSTINGS).parquet(f"{path}/postings")
    known = held.groupBy("bucket", "term").agg(F.count("*").alias("df"))
    known.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    # Every document has the sum of its counts as its length, but for those without a term.
    lengths = held.agg(F.sum(F.when(F.col("term") != "", F.col("tf"))).alias("all"))
    split.agg(F.count("*").alias("n")).crossJoin(lengths).select("n", (F.coalesce("all", F.lit(0)) / F.col("n")).alias("avg_len")).write.parquet(f"{path}/totals")


def of_terms(spark: SparkSession, path: str, table: str, schema: str, terms: list[str]) -> DataFrame:
    """The rows of some terms: their folders, and in those the row groups that hold them."""
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of(F.col("t"))).distinct().collect()]
    return spark.read.schema(schema).parquet(f"{path}/{table}").filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))


def rank(spark: SparkSession, path: str, terms: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Documents that hold every one of the distinct ``terms``, by BM25 (T2); ties by id. A top-k report."""
    terms = list(dict.fromkeys(terms))
    found = of_terms(spark, path, "postings", _POSTINGS, terms).groupBy("id", "collection", "len").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("tf"))
    found = found.filter(F.size("tf") == len(terms))
    stats = of_terms(spark, path, "terms", "term string, df long, bucket int", terms).agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df"))  # one row
    totals = spark.read.schema("n long, avg_len double").parquet(f"{path}/totals")
    j = found.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(totals))

    def part(term: str) -> Column:
        tf, df = F.col("tf")[term], F.col("df")[term]
        return F.ln(1.0 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))

    score = sum((part(t) for t in terms[1:]), part(terms[0]))
    best = j.select("id", "collection", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
