"""Blocks whose words differ under one name decide nothing; their windows do."""

import random

from pyspark.sql import functions as F

from strandline.llm import substring_dedup as SD


def _windows(found):
    return {(r.doc_id, at) for r in found.collect() for x in r.ranges for at in range(x["lo"], x["hi"] + 1)}


def test_differing_blocks_fall_back_to_windows(spark):
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    shared = words(120)
    docs = spark.createDataFrame(
        [(1, " ".join(words(80) + shared)), (2, " ".join(shared + words(60))), (3, " ".join(words(200))), (4, " ".join(words(10) + shared[20:90])), (5, "short")],
        "doc_id long, text string",
    )
    reduced = SD._reduce(docs, SD.WINDOW, SD.K)
    want = _windows(SD.repeated(docs, reduced))
    assert {d for d, _ in want} == {2, 4} and len(want) == 71 + 21
    one_name = reduced.withColumn("nodes", F.transform("nodes", lambda n: n.withField("kmer", F.lit(1).cast("long")).withField("block", F.lit(1).cast("long"))))
    assert _windows(SD.repeated(docs, one_name)) == want
