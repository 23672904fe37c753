"""Places in an order, against sorted lists."""

import math
import random

import pytest

from strandline.operators import ordering as O
from strandline.operators import universe as U


@pytest.mark.parametrize("kind", ["ties", "spread", "skewed", "infinite"])
def test_floor_quantiles(spark, kind):
    rng = random.Random(kind)
    one = {"ties": lambda: float(rng.randrange(4)), "spread": lambda: rng.uniform(-5, 5), "skewed": lambda: math.exp(rng.gauss(0, 4)), "infinite": lambda: rng.choice([1.0, 2.5, math.inf, -math.inf])}[kind]
    rows = [(k, one() if rng.random() < 0.9 else None) for k, n in [("hot", 900), ("b", 10), ("c", 1), (None, 7)] for _ in range(n)] + [("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    at = {"low": 0.05, "mid": 0.5, "high": 0.95, "top": 1.0}
    got = {r["_key"]["k"]: r for r in O.floor_quantiles(df, ["k"], "v", at).collect()}
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key and v is not None)
        if not values:
            assert key not in got
        else:
            assert [got[key][name] for name in at] == [values[math.floor((len(values) - 1) * p)] for p in at.values()]


def test_floor_quantiles_of_nothing(spark):
    assert O.floor_quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", {"mid": 0.5}).count() == 0


def test_ordered_merge(spark):
    rng = random.Random(1)
    rest = [(f"k{i}", rng.randrange(40) if i % 7 else None) for i in range(300)]
    first = rest[::9] + [("own", 3)]
    frame = lambda rows: spark.createDataFrame(rows, "symbol string, o int")
    best: dict = {}
    for part, rows in ((0, first), (1, rest)):
        for key, o in rows:
            best[key] = min(best.get(key, (9,)), (part, -1 if o is None else o))
    want = {key: i + 1 for i, key in enumerate(sorted(best, key=lambda key: (best[key], key)))}
    assert {r.symbol: r.position for r in U.ordered_merge(frame(first), frame(rest), "symbol", "o").collect()} == want
    assert U.ordered_merge(frame([]), frame([]), "symbol", "o").count() == 0
