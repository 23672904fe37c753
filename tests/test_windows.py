"""Search spaces, multi-pass fits, bootstraps, partial states, postings, gates and renderings against plain code."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import docs as D
from strandline.operators import perf as P
from strandline.operators import postings, space
from strandline.operators import research as R
from strandline.operators import state as S


# ---- search space -------------------------------------------------------------------------------------


def brute_space(base, axes, modes, rising, cap):
    lists = []
    for n, values in axes.items():
        distinct = list(dict.fromkeys(values))
        if not distinct:
            lists.append([base[n]])
        elif n in modes:
            lists.append([base[n], *(v for v in distinct if v != base[n])])
        else:
            lists.append(sorted(distinct, key=lambda v: (abs(v - base[n]), v)))
    names, out = list(axes), []
    for made in itertools.product(*lists):
        c = dict(zip(names, made))
        if all(c[a] <= c[b] for a, b in zip(rising, rising[1:])):
            out.append(made)
            if len(out) == cap:
                break
    return out


@pytest.mark.parametrize("cap", [1, 7, 100, 10_000])
def test_anchored_space(spark, cap):
    axes = {"mode": ["x", "y", "x"], "fast": [5, 1, 9, 5], "slow": [3, 20, 6], "q": [0.1, 0.3, 0.25], "none": []}
    bases = [{"k": 1, "mode": "y", "fast": 5, "slow": 6, "q": 0.1, "none": 7}, {"k": 2, "mode": "z", "fast": 4, "slow": 1, "q": 0.2, "none": 0}, {"k": 3, "mode": "x", "fast": 90, "slow": 90, "q": 9.0, "none": 1}]
    df = spark.createDataFrame([tuple(b.values()) for b in bases], "k int, mode string, fast int, slow int, q double, none int")
    got = space.anchored_space(df, ["k"], axes, modes=("mode",), rising=("fast", "slow"), cap=cap).orderBy("k", "place").collect()
    for b in bases:
        mine = [(r.mode, r.fast, r.slow, r.q, r.none) for r in got if r.k == b["k"]]
        assert mine == brute_space(b, axes, ("mode",), ("fast", "slow"), cap)
    assert tuple(got[0])[2:] == ("y", 5, 6, 0.1, 7)  # the anchor first


def test_a_huge_space_is_never_built(spark):
    axes = {f"a{i}": list(range(50)) for i in range(30)}
    base = spark.range(1).select(*[F.lit(25).alias(n) for n in axes], F.lit(1).alias("k"))
    rows = space.anchored_space(base, ["k"], axes, cap=120).orderBy("place").collect()
    assert len(rows) == 120 and [r.a29 for r in rows[:4]] == [25, 24, 26, 23] and rows[50].a28 == 24 and rows[0].a0 == 25


# ---- fits and bootstraps ------------------------------------------------------------------------------


def test_multipass_ridge_equals_a_fold_over_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2))
    y = 3 + x @ [2.0, -1.0] + rng.normal(0, 0.5, 60)
    df = spark.createDataFrame([(1, float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "k int, a double, b double, y double")
    got = R.ridge(R.gram(df, ["k"], ["a", "b"], "y"), ["k"], ["a", "b"], "y", penalty=5.0, prior={"a": 0.5}, min_n=80.0, passes=4).first()
    design, fitted = np.column_stack([np.ones(60), x]), np.zeros(3)
    for p in range(4):
        left = y - design @ fitted
        fitted = fitted + np.linalg.solve(design.T @ design + np.diag([0, 1, 1]) * 5.0 * (1 + 0.5 * p), design.T @ left) / (p + 1)
    want = fitted * 0.75 + np.array([0, 0.5, 0]) * 0.25
    assert [got.b_one, got.b_a, got.b_b] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("stationary", [True, False])
def test_reality_check_lies_in_the_simulated_band(spark, stationary):
    rng = np.random.default_rng(4)
    n, candidates = 100, 3
    series = rng.normal(0.0, 1.0, (candidates, n)) + np.array([0.02, 0.1, -0.1])[:, None]
    rows = [(f"c{k}", t, float(series[k, t])) for k in range(candidates) for t in range(n)]
    df = spark.createDataFrame(rows, "candidate string, time int, r double")
    got = P.reality_check(df, replications=400, stationary=stationary).first()
    size, centred, draws = round(math.sqrt(n)), series - series.mean(1, keepdims=True), []
    for _ in range(3000):
        means = []
        for c in centred:
            at, picks = 0, []
            for o in range(n):
                at = int(rng.integers(n)) if o == 0 or (rng.random() < 1 / size if stationary else o % size == 0) else (at + 1) % n
                picks.append(at)
            means.append(c[picks].mean())
        draws.append(max(means))
    p = (sum(d >= series.mean(1).max() for d in draws) + 1) / 3001
    assert got.block == 10 and got.best_mean == pytest.approx(series.mean(1).max()) and abs(got.p_value - p) < 4 * math.sqrt(p * (1 - p) / 400) + 0.01
    assert P.reality_check(df.filter("time < 7"), 20, stationary).first().p_value is None  # too short
    assert P.reality_check(df.filter("NOT (candidate = 'c1' AND time = 50)"), 20, stationary).first().p_value is None  # a bar is missing


def test_train_only(spark):
    blocks = [(1, 0, 10, 14, "train"), (1, 1, 15, 19, "purge"), (1, 2, 20, 24, "active"), (1, 3, 25, 29, "train"), (1, 4, 30, 33, "train"), (2, 0, 10, 14, "active"), (2, 1, 15, 33, "train")]
    folds = spark.createDataFrame(blocks, "fold int, block int, first_bar long, last_bar long, role string")
    role = {(f, i): r for f, _, a, b, r in blocks for i in range(a, b + 1)}
    for horizon in (0, 1, 3, 50):
        got = {(r.fold, r.bar): r.train_only for r in P.train_only(folds, horizon).collect()}
        assert got == {(f, i): all(role.get((f, j)) == "train" for j in range(i, i + horizon + 1)) for f, i in role}


# ---- partial states -----------------------------------------------------------------------------------


def test_partial_states_follow_the_delta(spark):
    rng, at = random.Random(1), dt.datetime(2024, 1, 1)
    rows = [("x", s, at + dt.timedelta(minutes=rng.randrange(5 * 1440)), rng.random() < 0.7) for s in "AB" for _ in range(60)]
    bars = lambda r: spark.createDataFrame(r, "exchange string, symbol string, time timestamp, is_finalized boolean")
    state = lambda df: sorted(map(str, df.select("exchange", "symbol", "earliest_feature_time", "latest_feature_time", "finalized_through", "feature_rows", "finalized_bars").collect()))
    held = S.feature_partials(bars(rows[:90]))
    late = [*rows[90:], rows[0]]  # new rows, and one that comes again
    gone = [r for r in rows if not (r[1] == "A" and r[2].day == 2)]  # a day that loses all its bars
    once = S.refreshed_partials(held, bars(rows), bars(late))
    twice = S.refreshed_partials(once, bars(rows), bars(late))
    assert state(S.state_of_partials(once)) == state(S.state_of_partials(twice)) == state(S.materialisation_state(bars(rows)))
    less = S.refreshed_partials(once, bars(gone), bars([r for r in rows if r[1] == "A" and r[2].day == 2]))
    assert state(S.state_of_partials(less)) == state(S.materialisation_state(bars(gone)))


# ---- postings -----------------------------------------------------------------------------------------


def test_postings_rank_and_read_their_terms_only(spark, tmp_path):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["Alpha", "beta", "gamma", "the", "Ünder", "x1"], [1, 3, 2, 9, 1, 1], k=rng.randrange(0, 60))) for _ in range(150)] + [None, "", "..."]
    rows = [(str(k), "c", t, "FAILED" if k % 10 == 3 else "COMPLETED") for k, t in enumerate(texts)]
    postings.build(spark.createDataFrame(rows, "id string, collection string, text string, embedding_status string"), str(tmp_path))
    done = {i: [w.lower() for w in (t or "").replace(".", " ").split()] for i, _, t, s in rows if s == "COMPLETED"}
    n, mean = len(done), sum(map(len, done.values())) / len(done)
    for terms in (["the"], ["alpha", "beta"], ["ünder", "x1", "the", "the"], ["alpha", "absent"]):
        df = {t: sum(t in w for w in done.values()) for t in terms}
        score = lambda w: sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in dict.fromkeys(terms))  # noqa: B023, E731
        want = sorted(((-score(w), i) for i, w in done.items() if all(t in w for t in terms)))[:20]
        got = postings.rank(spark, str(tmp_path), terms, 20).orderBy("rank").collect()
        assert [r.id for r in got] == [i for _, i in want] and [r.score for r in got] == pytest.approx([-s for s, _ in want])
    plan = postings.of_terms(spark, str(tmp_path), "postings", postings._POSTINGS, ["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "PartitionFilters: [bucket" in plan or "bucket" in plan.split("PartitionFilters")[1].split("]")[0]


# ---- gates and renderings -----------------------------------------------------------------------------


def test_entry_gates_by_hand(spark):
    signals = "time int, symbol string, direction string, expected_net_edge_bps double, confidence double, trend_agreement double, pullback double, expansion double, lower_bound double, upper_bound double, current_weight double"
    rows = [
        (1, "new", "LONG", 9.0, 0.9, 0.5, 1.0, 0.0, -9.0, 9.0, 0.0), (1, "held", "LONG", 1.0, 0.9, 0.12, 0.0, 0.0, -9.0, 9.0, 0.05), (1, "short", "SHORT", -9.0, 0.9, 0.5, 1.0, 0.0, -9.0, 9.0, 0.0),
        (2, "new", "LONG", 9.0, 0.9, 0.2, 0.0, 0.6, -9.0, 9.0, 0.0), (2, "short", "SHORT", -9.0, 0.9, 0.5, 1.0, 0.0, -9.0, 9.0, -0.1), (2, "weak", "LONG", 5.0, 0.1, 0.5, 1.0, 0.0, -9.0, 9.0, 0.0),
    ]
    regimes = spark.createDataFrame([(1, 0.6, 0.5, 0.5, 0.5), (2, 0.0, 0.1, -0.1, 0.05)], "time int, score double, anchor_trend double, breadth double, dispersion double")
    rules = R.GateRules(min_agreement=0.1, entry_edge_bps=4.0, hold_edge_bps=0.0, flat_gate="edge", flat_edge_boost_bps=6.0, flat_entry="combined", flat_min_dispersion=0.1, flat_agreement_boost=0.15)
    got = {(r.time, r.symbol): r for r in R.entry_gates(spark.createDataFrame(rows, signals), regimes, rules).collect()}
    failed = {k: sorted(c[5:] for c in r.asDict() if c.startswith("gate_") and not r[c]) for k, r in got.items()}
    assert failed == {(1, "new"): [], (1, "held"): [], (1, "short"): ["regime"], (2, "new"): ["agreement", "dispersion", "edge", "style"], (2, "short"): [], (2, "weak"): ["confidence", "dispersion", "edge", "tail"]}
    assert all(r.eligible == (not failed[k]) for k, r in got.items())


def test_texts(spark):
    one = spark.range(1)
    show = lambda c: one.select(c.alias("x")).first().x
    assert show(D.clean_manpage(F.lit(".TH X 1 d\n.SH NAME\nfoo - bar\n.PP\ntext \\fBbold\\fP\n.SH"))) == "\n### foo - bar\n\ntext \\fBbold\\fP\n.SH"
    assert len(show(D.clean_manpage(F.repeat(F.lit("a"), 5000)))) == 2000
    wiki = {"a {{x {{y {{z {{1{{2{{3{{4 q}}}}}}}}}}}}}} b": "a b", "{{open a b": "{{open a b", "x }} y": "x }} y", "{| t {{a}} |} z": "z", "{{a}}b{{c}}": "b", "": "", "{{a|b}}{| never": "{| never"}
    deep = "{{" * 300 + "in" + "}}" * 300 + " out"
    assert {t: show(D.clean_wikitext(F.lit(t))) for t in [*wiki, deep]} == wiki | {deep: "out"}
    assert [show(D.json_list(F.lit(t).cast("string"))) for t in ('["a", "b"]', '"a"', "bare", "", None, "null", "[broken")] == [["a", "b"], ["a"], ["bare"], [], [], [], []]
    assert [show(D.byte_size(F.lit(n).cast("long"))) for n in (0, 1023, 1024, 1536, 5 * 1024**2, 3 * 1024**3)] == ["0 B", "1023 B", "1.00 KB", "1.50 KB", "5.00 MB", "3.00 GB"]
