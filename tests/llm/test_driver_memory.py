"""What grows with the corpus is never broadcast, however small Spark takes it to be."""

import contextlib
import io

from pyspark.sql import functions as F

from strandline.llm import common, minhash, simhash


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.write.format("noop").mode("overwrite").save()  # what is decided while it runs is in the plan of the next run at the latest
        df.explain()
    return out.getvalue()


def fingerprints(spark):
    return common.materialize(spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.xxhash64(F.floor(F.col("id") / 6))).otherwise(F.xxhash64("id")).alias("fp")), "test-fp")


def test_index_and_components_broadcast_nothing(spark):
    fps = fingerprints(spark)
    assert "Broadcast" not in plan(simhash.links(fps))
    assert "Broadcast" not in plan(simhash.components(fps))
    assert "Broadcast" not in plan(minhash._indexed_pairs(fps.select(F.col("doc_id").alias("node"), "fp")))


def test_rounds_of_components_broadcast_nothing(spark, monkeypatch):
    plans = []
    written = common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, label: plans.append(plan(df)) or written(df, label))
    edges = spark.range(400).select(F.col("id").alias("src"), (F.col("id") + 1 + F.col("id") % 2).alias("dst"))
    assert common.connected(edges).filter("root <> 0").count() == 0
    assert len(plans) > 2 and not [p for p in plans if "Broadcast" in p]


def test_written_tables_leave_no_shuffle_files(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before, name = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had = spark.conf.get(name, None)
    written = common.materialize(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n")), "test-shuffled")
    assert files() <= before and spark.conf.get(name, None) == had
    assert written.agg(F.sum("n")).first()[0] == 10_000
