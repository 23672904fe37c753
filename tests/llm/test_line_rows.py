"""Line dedup over rows without an id, several texts under one id, and lines that share their hashes."""

import random

import pytest
from pyspark.sql import functions as F
from test_llm import passages_left

from strandline.llm import line_dedup


def run(k, n=4):
    return "\n".join(f"run {k} line {j} says this" for j in range(n))


def order(spark, rows):
    """The rows in the order of documents: by id (none last), then by the hash of the text."""
    hashed = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row", F.xxhash64("text")).collect()
    return sorted(hashed, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.row))


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.source: r.text for r in line_dedup.dedup_passages(df, drop_emptied=False).collect()}
    assert len(got) == len(rows)
    place, documents = {}, {}
    for r in order(spark, rows):
        if r.text is not None:
            place[r.source] = documents.setdefault((r.doc_id, r.text), len(documents))
    want = passages_left({n: text for (_, text), n in documents.items()})
    assert got == {s: None if t is None else want[place[s]] for _, t, s in rows}
    return got


def test_rows_without_an_id_and_texts_under_one_id(spark):
    rows = [
        (1, f"a\n{run(1)}\nb"), (None, f"c\n{run(1)}\nd"), (None, f"e\n{run(2)}\nf"), (None, f"g\n{run(2)}\nh"), (2, f"i\n{run(3)}\nj"), (2, f"k\n{run(3)}\nl"),
        (None, f"m\n{run(4)}\nn"), (3, f"o\n{run(4)}\np"), (3, f"q\n{run(5)}\n{run(5)}\nr"), (3, f"q\n{run(5)}\n{run(5)}\nr"), (None, None), (2, None), (None, ""), (None, f"g\n{run(2)}\nh"),
    ]
    got = check(spark, [(*r, f"s{k}") for k, r in enumerate(rows)])
    assert got["s1"] == "c\nd" and got["s6"] == "m\nn"  # those without an id yield to one with an id
    assert sum(len(got[s].split("\n")) == 6 for s in ("s2", "s3")) == 1 and sum(len(got[s].split("\n")) == 6 for s in ("s4", "s5")) == 1


@pytest.mark.parametrize("weak", [False, True])
def test_rows_of_any_id_against_brute_force(spark, monkeypatch, weak):
    """With weak hashes many different lines share both of them; then bytes decide, and nothing repeated stays."""
    if weak:
        monkeypatch.setattr(line_dedup, "_hashes", lambda x: ((F.length(x) % 5).cast("long").alias("h1"), F.lit(7).cast("long").alias("h2")))
    rng = random.Random(5)
    long = [" ".join(f"w{k}" for _ in range(50)) for k in range(3)]
    parts = ["a", "b b", "", " ", "c", "dd", run(1, 2), run(2, 3), *long]
    check(spark, [(rng.choice([None, None, 1, 2, 3, *range(10, 60)]), "\n".join(rng.choices(parts, k=rng.randint(1, 9))), f"s{k}") for k in range(160)])
