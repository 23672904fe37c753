"""Literal cases, invariants and rule traps of the operators."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import columns as col
from strandline.operators import bars as B
from strandline.operators import costs as C
from strandline.operators import docs as D
from strandline.operators import features as X
from strandline.operators import health as H
from strandline.operators import perf as P
from strandline.operators import research as R
from strandline.operators import state as S

T = lambda s: dt.datetime.fromisoformat(s)


def trades(spark):
    return spark.createDataFrame(
        [(T("2026-01-01 01:00:10"), "BTC", "x", "1", 100.0, 2.0, "buy"), (T("2026-01-01 01:00:20"), "BTC", "x", "2", 120.0, 1.0, "sell"), (T("2026-01-01 01:01:05"), "BTC", "x", "3", 90.0, 4.0, "buy")],
        "time timestamp, symbol string, exchange string, trade_id string, price double, size double, side string",
    )


def test_minute_trades(spark):
    a, b = B.minute_trades(trades(spark)).orderBy("time").collect()
    assert (a.trade_volume, a.buy_volume, a.sell_volume, a.trade_notional, a.trade_count) == (3.0, 2.0, 1.0, 320.0, 2)
    assert b.trade_volume == 4.0


def test_minute_books_latest_wins(spark):
    rows = [(T("2026-01-01 01:02:49"), "ETH", "x", 202.0, 203.0), (T("2026-01-01 01:02:11"), "ETH", "x", 200.0, 201.0)]
    df = spark.createDataFrame(rows, "time timestamp, symbol string, exchange string, best_bid double, best_ask double").selectExpr("*", "1.0D spread", "0.5D spread_pct", "202.5D mid_price", "4.0D bid_depth_10", "6.0D ask_depth_10")
    (r,) = B.minute_books(df).collect()
    assert (r.best_bid, r.best_ask, r.orderbook_samples, r.last_event_time) == (202.0, 203.0, 2, T("2026-01-01 01:02:49"))


def test_intervals(spark):
    df = spark.createDataFrame([("1m",), ("5m",), ("1h",), ("1d",), ("1w",), ("1M",), ("x",)], "i string")
    assert [r[0] for r in df.select(col.parse_interval_ms("i")).collect()] == [60_000, 300_000, 3_600_000, 86_400_000, 604_800_000, 2_592_000_000, None]


def test_paged_windows(spark):
    df = spark.createDataFrame([(T("2026-01-01 01:15:00"), T("2026-01-01 10:15:45"))], "a timestamp, b timestamp")
    got = [(r.page_start, r.page_end) for r in S.paged_windows(df, "a", "b", 3_600_000, 5, 2).orderBy("page").collect()]
    day = "2026-01-01 "
    assert got == [(T(day + "06:00:00"), T(day + "10:15:45")), (T(day + "03:00:00"), T(day + "07:59:59.999")), (T(day + "01:00:00"), T(day + "04:59:59.999"))]


def test_atr_and_vwap(spark):
    df = spark.createDataFrame([(1, "A", 100.0, 105.0, 95.0, 1000.0), (2, "A", 102.0, 108.0, 98.0, 1000.0), (3, "A", 101.0, 106.0, 96.0, 1000.0)], "time long, symbol string, close double, high double, low double, volume double")
    assert X.with_moves(df).withColumn("atr", X.atr(3)).orderBy("time").collect()[-1].atr == pytest.approx(10.0)
    v = spark.createDataFrame([(1, "A", 100.0, 101.0, 99.0, 1000.0), (2, "A", 110.0, 111.0, 109.0, 2000.0)], "time long, symbol string, close double, high double, low double, volume double")
    assert v.withColumn("v", X.vwap()).orderBy("time").collect()[-1].v == pytest.approx((100 * 1000 + 110 * 2000) / 3000)


def test_incomplete_windows_are_null(spark):
    df = spark.createDataFrame([(i, "A", float(100 + i)) for i in range(5)] + [(5, "A", None), (6, "A", 107.0)], "time int, symbol string, close double")
    rows = X.with_returns(df).withColumn("v", X.rolling_volatility(3)).orderBy("time").collect()
    assert [r.v is None for r in rows] == [True, True, True, False, False, True, True]


def test_ema_distance_equals_fold(spark):
    closes = [100.0, 103.0, 99.0, 104.0, 108.0]
    ema, alpha = float(np.mean(closes)), 2 / 6
    for c in closes[1:]:
        ema = alpha * c + (1 - alpha) * ema
    df = spark.createDataFrame([(i, "A", c) for i, c in enumerate(closes)], "time int, symbol string, close double")
    got = df.withColumn("d", X.ema_distance(5, F.lit(1.0))).orderBy("time").collect()[-1].d
    assert got == pytest.approx(math.log(closes[-1] / ema))


def test_as_of_includes_equal_time(spark):
    left = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "time int, symbol string")
    right = spark.createDataFrame([(0, "A", 1.0), (2, "A", 2.0), (9, "B", 3.0)], "time int, symbol string, f double")
    assert {(r.time, r.symbol): r.f for r in X.as_of_join(left, right, ["symbol"], "f").collect()} == {(1, "A"): 1.0, (2, "A"): 2.0, (3, "B"): None}


def test_merge_rules(spark):
    base = spark.createDataFrame([("a", 1, 5, True, None), ("b", 2, 7, False, "x")], "k string, n int, t int, f boolean, s string")
    delta = spark.createDataFrame([("b", 3, 6, True, "y"), ("c", 4, 1, False, "z")], "k string, n int, t int, f boolean, s string")
    got = {r.k: tuple(r)[1:] for r in S.merge(base, delta, ["k"], {"n": "add", "t": "greatest", "f": "or", "s": "first"}).collect()}
    assert got == {"a": (1, 5, True, None), "b": (5, 7, True, "x"), "c": (4, 1, False, "z")}
    late = S.merge(base, delta, ["k"], {"t": "latest", "n": "latest"}, time="t")
    assert {r.k: (r.t, r.n) for r in late.collect()}["b"] == (7, 2)


def test_finality_keeps_the_first_time(spark):
    df = B.finality(spark.createDataFrame([(T("2026-01-01 00:00:00"),)], "time timestamp"), F.lit("2026-01-01 00:07:00").cast("timestamp"), "5 MINUTES", 3)
    assert not df.first().is_finalized
    done = S.finalise_due(df, F.lit("2026-01-01 00:08:00").cast("timestamp"))
    again = S.finalise_due(done.drop("changed"), F.lit("2026-01-01 01:00:00").cast("timestamp")).first()
    assert again.is_finalized and again.finalized_at == T("2026-01-01 00:08:00") and not again.changed


def test_chunk_sizes():
    assert D.chunk_sizes(8192, 20, 90) == (7372, 1474)
    assert D.chunk_sizes(512, 20, 85) == (435, 87)


def test_token_chunks(spark):
    df = spark.createDataFrame([("s", "a b c"), ("l", " ".join(map(str, range(10))))], "id string, text string")
    rows = D.chunk_tokens(df, 4, 1).orderBy("id", "chunk_index").collect()
    assert [r.chunk for r in rows if r.id == "s"] == ["a b c"]
    assert [r.chunk for r in rows if r.id == "l"] == ["0 1 2 3", "3 4 5 6", "6 7 8 9", "9"]
    assert [r.chunk_id for r in rows if r.id == "l"][0] == "l-chunk-0"


def test_character_chunks_end(spark):
    df = spark.createDataFrame([("a", "x" * 25)], "id string, text string")
    assert [(r.start, len(r.chunk)) for r in D.chunk_chars(df, 10, 3).orderBy("start").collect()] == [(0, 10), (7, 10), (14, 10), (21, 4)]


def test_markdown_chunks(spark):
    text = "# A\n" + "x" * 600 + "\n## B\ny\n# C\nz"
    rows = D.chunk_markdown(spark.createDataFrame([("f", text)], "path string, text string")).orderBy("chunk_index").collect()
    assert [(r.section, len(r.content)) for r in rows] == [("A", 600), ("B", 6), ("C", 1)]


def test_content_types(spark):
    df = spark.createDataFrame([("cve_database",), ("legal_docs",), ("code_repo",), ("unknown_source",), ("rss",), ("wiki",)], "c string")
    assert [r[0] for r in df.select(D.content_type(F.col("c"), F.lit(""))).collect()] == ["vulnerability", "legal", "code", "document", "article", "documentation"]


def test_sentiment_rows(spark):
    schema = "id string, text string, metadata map<string,string>, created_at timestamp, model_score double, model_confidence double"
    rows = [("1", "The ETF gets inflows, crypto markets up.", {"title": "Bitcoin rally continues"}, T("2026-01-01 00:00:00"), 0.72, 2.0), ("2", "Why $ETH drops today", {"title": "$ETH drops", "published_date": "Tue, 3 Feb 2026 10:00:00 GMT"}, T("2026-01-01 00:00:00"), -0.68, 0.5), ("3", "bitcoin", {"chunk_index": "1"}, T("2026-01-01 00:00:00"), 0.1, 0.1)]
    df = spark.createDataFrame(rows, schema)
    symbols = D.extract_symbols(F.col("metadata")["title"], F.concat_ws(" ", F.col("metadata")["title"], "text"), ["BTC", "ETH"], {"bitcoin": "BTC", "ethereum": "ETH"}, ["crypto"], {})
    got = {(r.doc_id, r.symbol): (r.sentiment_label, r.confidence, r.observed_at) for r in D.sentiment_rows(df, symbols).collect()}
    assert set(got) == {("1", "BTC"), ("1", "CRYPTO_GLOBAL"), ("2", "ETH")}
    assert got["1", "BTC"][:2] == ("bullish", 1.0) and got["2", "ETH"] == ("bearish", 0.5, T("2026-02-03 10:00:00"))


def test_vulnerability(spark):
    text = '{"id":"CVE-1","descriptions":[{"lang":"es","value":"hola"},{"lang":"en","value":"hello"}],"metrics":{"cvssMetricV2":[{"cvssData":{"baseScore":7.5}}]},"references":[{"url":"u1"},{}],"configurations":{"nodes":[{"cpeMatch":[{"criteria":"cpe:2.3:a:acme:tool:1"},{"criteria":"cpe:2.3:a:acme:tool:2"}]}]}}'
    (r,) = D.flatten_vulnerability(spark.createDataFrame([(text,)], "json string")).collect()
    assert (r.id, r.description, r.severity, r.base_score, r.references, r.products) == ("CVE-1", "hello", "HIGH", 7.5, ["u1"], ["acme:tool"])


def test_incumbent_weighs_more(spark):
    schema = "time int, symbol string, score double, expected_net_edge_bps double, confidence double, volatility double, liquidity double, current_weight double, turnover_penalty_bps double"
    rows = [(1, "INCUMBENT", 4.0, 4.0, 0.8, 0.02, 0.8, 0.08, 3.0), (1, "CHALLENGER", 5.0, 5.0, 0.8, 0.02, 0.8, 0.0, 3.0)]
    w = {r.symbol: r.weight for r in R.allocate(spark.createDataFrame(rows, schema), quantile=0.5, gross=0.08, max_weight=0.08, long_short=False).collect()}
    two = {r.symbol: r.weight for r in R.allocate(spark.createDataFrame(rows, schema), quantile=1.0, gross=0.08, max_weight=0.08, long_short=False).collect()}
    assert w.get("INCUMBENT", 0) > w.get("CHALLENGER", 0) and two["INCUMBENT"] > two["CHALLENGER"]


def test_ridge_equals_least_squares(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = 1.5 + x @ [2.0, -1.0] + rng.normal(size=200) * 0.01
    df = spark.createDataFrame([("k", float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "k string, a double, b double, y double")
    (r,) = R.ridge(R.gram(df, ["k"], ["a", "b"], "y"), ["k"], ["a", "b"], "y", penalty=0.0).collect()
    assert (r.b_one, r.b_a, r.b_b) == pytest.approx((1.5, 2.0, -1.0), abs=0.01) and r.r2 > 0.99


def test_ewma_beta_and_sleeves(spark):
    rows = [(i, s, float(100 * math.exp(0.01 * i * k + 0.02 * math.sin(i)))) for i in range(30) for k, s in ((1, "A"), (2, "B"))]
    grid = spark.createDataFrame(rows, "time int, symbol string, close double")
    out = R.rolling_beta(grid, R.market_proxy(grid), 8, half_life=4).filter("beta IS NOT NULL").collect()
    assert out and all(-3 <= r.beta <= 3 for r in out)
    s = R.sleeve_correlation(X.with_returns(grid).filter("r IS NOT NULL").select(F.lit(1).alias("key"), "time", F.col("symbol").alias("sleeve"), "r")).first()
    assert s.avg_correlation == pytest.approx(1.0, abs=1e-6) and 0.9 < s.first_share <= 1.0 + 1e-9


def test_normal_functions(spark):
    r = spark.range(1).select(col.normal_cdf(F.lit(1.96)).alias("c"), col.inverse_normal_cdf(F.lit(0.975)).alias("i"), col.inverse_normal_cdf(F.lit(0.001)).alias("t")).first()
    assert r.c == pytest.approx(0.975, abs=1e-4) and r.i == pytest.approx(1.959964, abs=1e-5) and r.t == pytest.approx(-3.090232, abs=1e-5)


def test_bootstrap_and_reality_check_repeat(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(c, i, float(rng.normal(0.5 if c == "good" else 0.0, 0.1))) for c in ("good", "flat") for i in range(40)], "candidate string, time int, r double")
    a, b = P.reality_check(df, 50).first(), P.reality_check(df, 50).first()
    assert a == b and a.p_value < 0.1
    p = {r.candidate: r for r in P.bootstrap(df, ["candidate"], 50).collect()}
    assert p["good"].sharpe_p05 > p["flat"].sharpe_p05


def test_promotion_lists_failures(spark):
    df = spark.createDataFrame([(0.01, 1.0, 0.5, 0.1, 0.8), (0.5, 0.1, 0.5, 0.9, 0.1)], "q_value double, sharpe double, benchmark double, white_p double, pass_ratio double")
    assert [r.failed_controls for r in P.promotion(df).collect()] == [[], ["multiplicity", "deflated_sharpe", "reality_check", "purged_folds"]]


def test_ema_backtest_equals_pandas(spark):
    rng = np.random.default_rng(5)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 120)))
    df = spark.createDataFrame([("A", i, float(c)) for i, c in enumerate(close)], "symbol string, time int, close double")
    got = P.cross_backtest(X.ema(df, {"ema_fast": 5, "ema_slow": 21})).orderBy("time").toPandas()
    p = pd.DataFrame({"close": close})
    ret = p.close.pct_change().fillna(0)
    vol = ret.rolling(60, min_periods=1).std(ddof=0)
    signal = ((p.close.ewm(span=5, adjust=False).mean() > p.close.ewm(span=21, adjust=False).mean()) & (vol <= vol.expanding().mean())).astype(float)
    position = signal.shift(1).fillna(0)
    net = position * ret - position.diff().abs().fillna(position.abs()) * 6 / 10_000
    np.testing.assert_allclose(got.equity, (1 + net).cumprod(), rtol=1e-9)


def test_health_rules(spark):
    df = spark.createDataFrame([(0.9, 10), (0.1, None)], "coverage double, n int")
    got = H.check_rules(df, {"coverage": F.col("coverage") > 0.5, "n": F.col("n") > 5}).collect()
    assert [(r.accepted, r.reasons) for r in got] == [(True, []), (False, ["coverage", "n"])]


def test_costs_and_orders(spark):
    df = spark.createDataFrame([(0.05, 0.9), (0.01, 0.1)], "weight double, confidence double")
    rows = C.child_orders(df, step=0.02).orderBy("confidence", "sequence").collect()
    ramp = [r.child_weight for r in rows if r.style == "MAKER_RAMP"]
    assert sum(ramp) == pytest.approx(0.05) and ramp == sorted(ramp) and len(ramp) == 3
    f = spark.createDataFrame([(0.1, 0.01, 10.0, 100.0, 0.5, 0.0001)], "spread_pct double, ret double, depth double, mid_price double, micro_alpha double, funding_rate double")
    r = C.forward_costs(f).first()
    assert r.total_cost_bps == pytest.approx(r.fee_bps + r.spread_cost_bps + r.slippage_bps + r.impact_bps + r.adverse_selection_bps + r.funding_drift_bps)


def test_purged_folds_keep_sides_apart(spark):
    df = spark.createDataFrame([(i,) for i in range(60)], "time int")
    rows = P.purged_folds(df, 0, 3, 5, 2, 1).collect()
    for fold in {r.fold for r in rows}:
        role = {r.block: r.role for r in rows if r.fold == fold}
        assert all(role.get(b + d) != "train" for b, x in role.items() if x == "active" for d in (-1, 1))


def test_late_rows_change_a_final_bar(spark):
    schema = "time timestamp, close double"
    final = lambda rows, at: B.finality(spark.createDataFrame(rows, schema), F.lit(at).cast("timestamp"), "1 HOUR", 3)
    stored = final([(T("2026-01-01 00:00"), 1.0), (T("2026-01-01 01:00"), 2.0), (T("2026-01-01 02:00"), 3.0)], "2026-01-01 02:10:00")
    fresh = final([(T("2026-01-01 00:00"), 9.0), (T("2026-01-01 01:00"), 5.0), (T("2026-01-01 03:00"), 6.0)], "2026-01-01 04:10:00")
    rows = S.refresh(stored, fresh, ["time"], ["close"], F.lit("2026-01-01 01:00:00").cast("timestamp")).orderBy("time").collect()
    # Before the refreshed range; changed by late rows; not computed anew; new.
    assert [r.close for r in rows] == [1.0, 5.0, 3.0, 6.0]
    assert [r.is_finalized for r in rows] == [True, True, False, True] and [r.is_provisional for r in rows] == [False, False, True, False]
    assert [r.finalized_at and r.finalized_at.hour for r in rows] == [2, 2, None, 4]
