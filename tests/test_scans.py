"""Blocked scans against folds over whole keys: hot keys, nulls, ties of order, blocks of several runs."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import features as X
from strandline.operators import scans


@pytest.fixture(scope="module")
def ticks(spark):
    """Three symbols, one with nine rows of ten; gaps of months, null closes at the start and in between, a null symbol."""
    rng, start = np.random.default_rng(7), dt.datetime(2024, 1, 1)
    rows = []
    for symbol, n in (("HOT", 2700), ("B", 200), (None, 99), ("C", 1)):
        at = np.cumsum(rng.choice([7, 60, 3600, 3_000_000], n, p=[0.6, 0.3, 0.09, 0.01])).astype(int)
        price = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        rows += [(symbol, start + dt.timedelta(seconds=int(t)), None if k < 3 and n > 9 or rng.random() < 0.05 else float(p)) for k, (t, p) in enumerate(zip(at, price))]
    order = rng.permutation(len(rows))
    return spark.createDataFrame([rows[i] for i in order], "symbol string, time timestamp, close double")


def folded(pdf, n):
    """The recursive average in page order; a missing value keeps it."""
    alpha, state, out = 2.0 / (n + 1), None, []
    for x in pdf["close"]:
        if not np.isnan(x):
            state = x if state is None else (1 - alpha) * state + alpha * x
        out.append(np.nan if state is None else state)
    return np.array(out)


@pytest.mark.parametrize("run,top,width", [(32, 1024, scans.DAY), (2, 8, 3600), (8, 16, 1 << 40), (32, 4, 60)])
def test_recursive_averages_equal_a_fold(spark, ticks, monkeypatch, run, top, width):
    """Small runs and tops need several levels of blocks."""
    monkeypatch.setattr(scans, "RUN", run)
    monkeypatch.setattr(scans, "TOP", top)
    got = X.ema(ticks, {"a": 5, "b": 55}, width=width).toPandas()
    assert len(got) == 3000
    for _, part in got.groupby("symbol", dropna=False):
        part = part.sort_values("time")
        for name, n in (("a", 5), ("b", 55)):
            np.testing.assert_allclose(part[name].to_numpy(dtype=float), folded(part, n), rtol=1e-10)


def test_no_python_and_no_task_with_a_whole_key(spark, ticks):
    out = X.macd(ticks)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    rows = ticks.withColumn("block", scans.block_of(ticks, "time", 3600)).groupBy("symbol", "block").count().agg(F.max("count")).first()[0]
    assert rows < 1000  # of the 2,700 rows of the hot symbol
    a = out.toPandas()
    for _, part in a.groupby("symbol", dropna=False):
        part = part.sort_values("time")
        line = folded(part, 12) - folded(part, 26)
        np.testing.assert_allclose(part["macd"].to_numpy(dtype=float), line, atol=1e-9)
        np.testing.assert_allclose(part["macd_signal"].to_numpy(dtype=float), folded(pd.DataFrame({"close": line}), 9), atol=1e-9)


@pytest.mark.parametrize("width", [60, scans.DAY, 1 << 40])
def test_as_of_join_with_a_hot_key(spark, ticks, width):
    rng = np.random.default_rng(3)
    times = [r.time for r in ticks.filter("symbol = 'HOT'").collect()]
    right = [("HOT", t + dt.timedelta(seconds=int(rng.integers(-1, 2))), None if rng.random() < 0.2 else float(k)) for k, t in enumerate(times) if rng.random() < 0.1]
    right = list({(s, t): (s, t, v) for s, t, v in right}.values()) + [("B", times[0], 5.0), (None, times[5], 6.0), ("HOT", None, 7.0)]
    left = ticks.unionByName(spark.createDataFrame([("HOT", None, 1.0)], ticks.schema))
    got = X.as_of_join(left, spark.createDataFrame(right, "symbol string, time timestamp, f double"), ["symbol"], "f", width=width).collect()
    assert len(got) == 3001
    known = {}
    for s, t, v in right:
        if t is not None and v is not None:
            known.setdefault(s, []).append((t, v))
    for r in got:
        before = [x for x in known.get(r.symbol, []) if r.time is not None and x[0] <= r.time]
        assert r.f == (max(before)[1] if before else None)


def test_empty_and_numbers_as_time(spark):
    empty = spark.createDataFrame([], "symbol string, time int, close double")
    assert X.ema(empty, {"a": 5}).count() == 0 and X.as_of_join(empty, empty.withColumnRenamed("close", "f"), ["symbol"], "f").count() == 0
    rows = spark.createDataFrame([("A", k, float(k)) for k in range(9)], empty.schema)
    assert X.ema(rows, {"a": 1}, width=2).filter("a <> close").count() == 0
