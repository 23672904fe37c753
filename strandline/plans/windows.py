"""Registered queries on incremental state, search spaces, train-only windows, multi-pass fits, bootstraps, entry gates and renderings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import columns as K
from strandline.operators import bars as B
from strandline.operators import costs as C
from strandline.operators import docs as D
from strandline.operators import health as H
from strandline.operators import perf as P
from strandline.operators import research as R
from strandline.operators import space
from strandline.operators import state as S
from strandline.operators import universe as U
from strandline.plans import market as M
from strandline.plans.common import Market, as_of, query, rounded, rr, sql
from strandline.plans.research import _EDGE, _GX, _W, _edges, _rk, _ret, _signals
from strandline.sources import io
from strandline.sources.scratch import stored

_WX = "PARTITION BY symbol, exchange ORDER BY time"
_CUT, _LATE_DAY = "2024-01-20", "2024-01-10"


@query("incremental_state", sql("SELECT exchange, symbol, min(time) AS earliest_feature_time, max(time) AS latest_feature_time, max(time) FILTER (WHERE is_finalized) AS finalized_through, count(*) AS feature_rows, count(*) FILTER (WHERE is_finalized) AS finalized_bars FROM b5 GROUP BY 1, 2", "b5"))
def incremental_state(m: Market):
    """K6: parts held up to a day, refreshed with the days after it and one that late rows changed; equal to all bars at once."""
    bars = stored(m.bars_5m, "bars")
    day = F.to_date("time")
    held = S.feature_partials(bars.filter((day < _CUT) & ((day != _LATE_DAY) | (F.col("trade_count") > 1))))
    changed = bars.filter((day >= _CUT) | (day == _LATE_DAY)).select("exchange", "symbol", "time")
    return S.state_of_partials(S.refreshed_partials(held, bars, changed))


_AXES = {"mode": ["Brand#12", "Brand#34"], "quantile": [0.1, 0.2, 0.4], "fast": [1, 3, 5, 7], "medium": [4, 8, 12], "slow": [6, 12, 30, 48]}
_BASES = "SELECT p_partkey, p_brand AS mode, CAST(p_size % 5 AS DOUBLE) / 10 AS quantile, 1 + p_size % 7 AS fast, 4 + p_size % 9 AS medium, p_size AS slow FROM part"
_list = lambda n: f"(SELECT unnest({_AXES[n]}) AS v) {n[0]}"


@query("search_space", f"""SELECT * FROM (SELECT b.p_partkey, row_number() OVER (PARTITION BY b.p_partkey ORDER BY o.k, abs(q.v - b.quantile), q.v, abs(f.v - b.fast), f.v, abs(m.v - b.medium), m.v, abs(s.v - b.slow), s.v) - 1 AS place, o.v AS mode, CAST(q.v AS DOUBLE) AS quantile, f.v AS fast, m.v AS medium, s.v AS slow
    FROM ({_BASES}) b, (SELECT p_partkey, unnest(w) AS v, unnest(range(len(w))) AS k FROM (SELECT p_partkey, [mode] || list_filter({_AXES['mode']}, lambda x: x <> mode) AS w FROM ({_BASES}))) o, {_list('quantile')}, {_list('fast')}, {_list('medium')}, {_list('slow')}
    WHERE o.p_partkey = b.p_partkey AND f.v <= m.v AND m.v <= s.v) WHERE place < 24""")
def search_space(m: Market):
    """The first 24 configurations around each part's own."""
    size = F.col("p_size")
    bases = m.table("part").select("p_partkey", F.col("p_brand").alias("mode"), ((size % 5).cast("double") / 10).alias("quantile"), (1 + size % 7).alias("fast"), (4 + size % 9).alias("medium"), size.alias("slow"))
    return space.anchored_space(bases, ["p_partkey"], _AXES, modes=("mode",), rising=("fast", "medium", "slow"), cap=24)


_FOLDS = {
    "bl": "SELECT CAST(floor((i - 10) / 12) AS INT) AS block, min(i) AS first_bar, max(i) AS last_bar FROM (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i FROM (SELECT DISTINCT time FROM db)) WHERE i >= 10 GROUP BY 1",
    "fo": "SELECT fold, block, first_bar, last_bar, CASE WHEN block >= s AND block < s + 2 THEN 'active' WHEN block >= s - 1 AND block < s + 3 THEN 'purge' ELSE 'train' END AS role FROM bl CROSS JOIN (SELECT p + 1 AS fold, CAST(floor(p * (n - 2) / 3.0 + 0.5) AS BIGINT) AS s FROM (SELECT unnest(generate_series(0, 3)) AS p), (SELECT count(*) AS n FROM bl))",
    "ba": "SELECT fold, role, unnest(range(first_bar, last_bar + 1)) AS bar FROM fo",
}


@query("train_only", sql("SELECT fold, bar, role, count(*) FILTER (WHERE role = 'train') OVER w = 6 AS train_only FROM ba WINDOW w AS (PARTITION BY fold ORDER BY bar ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)", "db", extra=_FOLDS))
def train_only(m: Market):
    """Bars whose label, five bars on, lies in training blocks all the way."""
    return P.train_only(P.purged_folds(m.daily_bars, 10, 4, 12, 2, 1), 5)


@query("ridge_multipass")
def ridge_multipass(m: Market):
    """Three passes with a prior; the tests compare it with a fold over rows."""
    return R.ridge(R.gram(_signals(m), ["symbol"], _GX, "close"), ["symbol"], _GX, "close", prior={"fast_return": 0.55, "slope": 0.3}, min_n=200.0, passes=3)


@query("reality_check_circular")
def reality_check_circular(m: Market):
    """Hashed draws, so there is no SQL form; the tests compare p with a simulation."""
    return P.reality_check(_ret(m).select(F.col("symbol").alias("candidate"), "time", "r"), stationary=False)


# ---- entry gates -----------------------------------------------------------------------------------

_RULES = R.GateRules(min_confidence=0.3, min_agreement=0.1, entry_edge_bps=2.0, hold_edge_bps=-5.0, plateau_bps=3.0, suppression=0.2, flat_trend=0.4, flat_breadth=0.3, flat_gate="combined", flat_edge_boost_bps=4.0, flat_entry="combined", flat_min_dispersion=0.1, flat_agreement_boost=0.15)
_GATES = {
    **_EDGE,
    "rgm": f"SELECT time, (avg(km) + avg(ks) + avg((km + ks) / 2) + coalesce(avg((km + ks) / 2) FILTER (WHERE symbol IN ('click', 'view')), 0)) / 4 AS score, coalesce(avg((km + ks) / 2) FILTER (WHERE symbol IN ('click', 'view')), 0) AS market_trend, avg((km + ks) / 2) AS breadth, least(stddev_pop(medium_return), 5) / 5 AS dispersion FROM (SELECT *, {_rk('medium_return')} AS km, {_rk('slow_return')} AS ks FROM sig) GROUP BY time",
    "bnd": "SELECT time, list_sort(list(edge))[CAST(floor((count(*) - 1) * 0.25) AS BIGINT) + 1] AS lo, list_sort(list(edge))[CAST(floor((count(*) - 1) * 0.75) AS BIGINT) + 1] AS hi FROM ed GROUP BY time",
    "g1": "SELECT ed.*, lo, hi, score, dispersion, edge >= 0 AS long, CASE WHEN residual_rank > 0.4 THEN 0.05 WHEN residual_rank < -0.4 THEN -0.05 ELSE 0 END AS cw, abs(market_trend) <= 0.4 AND abs(breadth) <= 0.3 AS flat FROM ed JOIN bnd USING (time) JOIN rgm USING (time)",
    "g2": "SELECT *, CASE WHEN long THEN edge ELSE -edge END AS de, CASE WHEN long THEN cw > 1e-9 ELSE cw < -1e-9 END AS held FROM g1",
    "g3": """SELECT time, symbol, held AS incumbent, confidence >= 0.3 AS gate_confidence, trend_agreement >= CASE WHEN flat AND NOT held THEN 0.25 ELSE 0.1 END AS gate_agreement, held OR pullback >= 1 OR (expansion >= 0.55 AND trend_agreement >= 0.25) AS gate_style,
        abs(score) < 0.2 OR CASE WHEN score > 0 THEN long ELSE NOT long END AS gate_regime, NOT (flat AND NOT held) OR dispersion >= 0.1 AS gate_dispersion, de >= CASE WHEN held THEN -5.0 WHEN flat THEN 6.0 ELSE 2.0 END AS gate_edge, de + 3.0 >= CASE WHEN long THEN hi ELSE -lo END OR (held AND de >= -5.0) AS gate_tail FROM g2""",
}


@query("entry_gates", sql("SELECT *, gate_confidence AND gate_agreement AND gate_style AND gate_regime AND gate_dispersion AND gate_edge AND gate_tail AS eligible FROM g3", "gr", extra=_GATES))
def entry_gates(m: Market):
    """R16 with all gates; positions are held on the side of the outer ranks."""
    rank = F.col("residual_rank")
    edges = stored(_edges(m).withColumn("current_weight", F.when(rank > 0.4, 0.05).when(rank < -0.4, -0.05).otherwise(0.0)), "edges")
    out = R.entry_gates(edges, R.regimes(_signals(m), ("click", "view")), _RULES)
    return out.select("time", "symbol", "incumbent", *[c for c in out.columns if c.startswith("gate_")], "eligible")


# ---- drift, repair, sweeps -------------------------------------------------------------------------

_LIVE_RUNS = "SELECT CASE WHEN o_orderstatus = 'F' THEN 'A' WHEN o_orderstatus = 'O' THEN 'N' ELSE 'R' END AS strategy_name, CAST(o_orderkey % 20 AS VARCHAR) AS symbol, trades, net_return_pct, run_at, run_id FROM runs JOIN orders ON run_id = o_orderkey"


@query("drift_score", sql(f"""SELECT strategy_name, exchange, symbol, observed_at, order_key, {rr('live AS live_edge_bps', 'e AS backtest_edge_bps', 'fq AS fill_quality_delta_bps', 'sd AS slippage_drift_bps', 'ld AS latency_drift_ms', 'greatest(fq, 0) + greatest(sd, 0) + greatest(ld, 0) / 100 + greatest(coalesce(e, 0) - live, 0) AS drift_score', digits=4)} FROM
    (SELECT *, -total_cost_bps AS live, (avg(fill_ratio) OVER k - fill_ratio) * 10000 AS fq, slippage_bps - avg(slippage_bps) OVER k AS sd, fill_ms - avg(fill_ms) OVER k AS ld FROM (SELECT *, 0.8 + requested / 500.0 AS fill_ratio FROM costs) JOIN
    (SELECT strategy_name, exchange, symbol, observed_at, avg(order_key % 997) AS fill_ms FROM costs GROUP BY ALL) USING (strategy_name, exchange, symbol, observed_at) WINDOW k AS (PARTITION BY strategy_name, symbol))
    LEFT JOIN (SELECT strategy_name, symbol, arg_max(CASE WHEN trades > 0 THEN net_return_pct * 100 / trades ELSE net_return_pct * 100 END, (run_at, run_id)) AS e FROM lr GROUP BY ALL) USING (strategy_name, symbol)""", "costs", "runs", extra={"lr": _LIVE_RUNS}))
def drift_score(m: Market):
    """With latencies at the same instants and the score of all four parts."""
    four = ["strategy_name", "exchange", "symbol", "observed_at"]
    costs = m.costs.withColumn("fill_ratio", 0.8 + F.col("requested") / 500.0)
    latency = costs.groupBy(*four).agg(F.avg(F.col("order_key") % 997).alias("fill_ms"))
    d = P.drift(costs, latency, _live_runs(m))
    return rounded(d.select(*four, "order_key", "live_edge_bps", "backtest_edge_bps", "fill_quality_delta_bps", "slippage_drift_bps", "latency_drift_ms", "drift_score"), 4)


def _live_runs(m: Market):
    status = F.col("o_orderstatus")
    names = m.table("orders").select(F.col("o_orderkey").alias("run_id"), F.when(status == "F", "A").when(status == "O", "N").otherwise("R").alias("strategy_name"), (F.col("o_orderkey") % 20).cast("string").alias("symbol"))
    return m.runs.drop("strategy_name", "symbol").join(names, "run_id")


@query("baseline_latest_run", sql(f"SELECT strategy_name, {rr('avg(total_cost_bps) AS avg_total_cost_bps', 'avg(slippage_bps) AS avg_slippage_bps', 'avg(CASE WHEN order_key % 3 <> 0 THEN requested / 50.0 END) AS avg_fill_ratio', 'max(e) AS backtest_edge_bps')} FROM costs LEFT JOIN (SELECT strategy_name, arg_max(CASE WHEN trades > 0 THEN net_return_pct * 100 / trades END, (run_at, run_id)) AS e FROM lr WHERE trades > 0 GROUP BY 1) USING (strategy_name) GROUP BY 1", "costs", "runs", extra={"lr": _LIVE_RUNS}))
def baseline_latest_run(m: Market):
    """Costs by strategy beside the edge per trade of its latest run with trades."""
    fill = F.when(F.col("order_key") % 3 == 0, F.lit('{"fillRatio": "n/a"}')).otherwise(F.concat(F.lit('{"fillRatio": '), (F.col("requested") / 50.0).cast("string"), F.lit("}")))
    return rounded(C.execution_baseline(m.costs.withColumn("metadata", fill), _live_runs(m).filter("trades > 0")))


_FAST, _SLOW = (2, 3, 5), (8, 10, 20)
_SWEPT = {
    "sa0": f"SELECT symbol, time, coalesce(close / nullif(lag(close) OVER ({_W}), 0) - 1, 0) AS ret, row_number() OVER ({_W}) AS i, count(*) OVER (PARTITION BY symbol) AS n, {', '.join(f'avg(close) OVER ({_W} ROWS {n - 1} PRECEDING) AS a{n}' for n in (*_FAST, *_SLOW))} FROM db",
    "sg": " UNION ALL ".join(f"SELECT symbol, time, ret, i, n, {f} AS fast, {s} AS slow, a{f} AS fa, a{s} AS sa FROM sa0" for f in _FAST for s in _SLOW),
    "sp": "SELECT *, coalesce(lag(CASE WHEN fa - sa > 1e-9 THEN 1.0 ELSE 0.0 END) OVER pw, 0) AS pos FROM sg WINDOW pw AS (PARTITION BY symbol, fast, slow ORDER BY time)",
    "sn": "SELECT *, greatest(pos * ret - abs(pos - coalesce(lag(pos) OVER pw, 0)) * 6 / 10000.0, -0.9999) AS net FROM sp WINDOW pw AS (PARTITION BY symbol, fast, slow ORDER BY time)",
    "st": "SELECT symbol, fast, slow, exp(sum(CASE WHEN i <= floor(n * 0.7::DOUBLE) THEN ln(1 + net) ELSE 0 END)) - 1 AS train_return, exp(sum(CASE WHEN i > floor(n * 0.7::DOUBLE) THEN ln(1 + net) ELSE 0 END)) - 1 AS test_return FROM sn GROUP BY 1, 2, 3",
}


@query("sweep_best", sql(f"SELECT symbol, fast, slow, rank, {rr('train_return', 'test_return', digits=8)} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(train_return, 10) DESC, fast, slow) AS rank FROM st) WHERE rank <= 5", "db", extra=_SWEPT))
def sweep_best(m: Market):
    """B2: the five best of nine parameter pairs in sample, and what they do out of it."""
    return rounded(P.best_out_of_sample(P.sweep(m.daily_bars, list(_FAST), list(_SLOW)), ["symbol"], ["fast", "slow"], 5), 8)


@query("relative_volatility", sql(f"SELECT symbol, time, {rr('v / nullif(med, 0) AS relative_volatility')} FROM (SELECT *, CASE WHEN count(v) OVER w = 20 THEN median(v) OVER w END AS med FROM (SELECT symbol, time, CASE WHEN count(r) OVER (PARTITION BY symbol ORDER BY time ROWS 9 PRECEDING) = 10 THEN stddev_samp(r) OVER (PARTITION BY symbol ORDER BY time ROWS 9 PRECEDING) END AS v FROM gr) WINDOW w AS (PARTITION BY symbol ORDER BY time ROWS 19 PRECEDING))", "gr"))
def relative_volatility(m: Market):
    """The deviation of ten returns over its median of twenty bars."""
    from strandline.operators import features as X

    ten = X.frame(X.BY, "time", 9)
    df = X.with_returns(m.grid).withColumn("v", F.when(F.count("r").over(ten) == 10, F.stddev_samp("r").over(ten)))
    return rounded(df.withColumn("relative_volatility", X.relative_to_median("v", 20)).select("symbol", "time", "relative_volatility"))


# ---- renderings ------------------------------------------------------------------------------------


@query("manpages", sql(r"""SELECT id, '# ' || id || chr(10) || chr(10) || '**Type:** man' || chr(10) || '**Section:** 1' || chr(10) || '**Path:** /' || source || chr(10) || chr(10) || '## Content' || chr(10) || chr(10) || left(c, 2000) || CASE WHEN length(t) > 2000 THEN chr(10) || chr(10) || '...' || chr(10) || '*(Full content: ' || length(t) || ' characters)*' ELSE '' END AS page FROM
    (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, '\.TH[^\n]*\n', '', 'g'), '\.SH[^\n]*\n', chr(10) || '### ', 'g'), '\.[A-Z]{2}[^\n]*\n', chr(10), 'g') AS c FROM (SELECT id, source, '.TH ' || id || ' 1' || chr(10) || '.SH NAME' || chr(10) || replace(coalesce(text, ''), chr(10), chr(10) || '.PP' || chr(10)) AS t FROM staging))""", "staging"))
def manpages(m: Market):
    """F16: the given texts set as man pages, a paragraph request between lines."""
    page = F.concat(F.lit(".TH "), "id", F.lit(" 1\n.SH NAME\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n.PP\n")))
    return m.staging.select("id", D.render_manpage(F.col("id"), F.lit("man"), F.lit("1"), F.concat(F.lit("/"), "source"), page).alias("page"))


@query("render_torrents", sql("""SELECT infohash, concat_ws(chr(10), '# ' || p_name, '', '**Infohash:** ' || infohash, '**Size:** ' || CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.2f', n / 1024.0::DOUBLE) || ' KB' WHEN n < 1073741824 THEN printf('%.2f', n / 1048576.0::DOUBLE) || ' MB' ELSE printf('%.2f', n / 1073741824.0::DOUBLE) || ' GB' END,
    CASE WHEN p_size % 3 <> 0 THEN '**Created:** ' || strftime(make_timestamp((1700000000 + p_partkey) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END, '**Seeders:** ' || p_size || ' | **Leechers:** ' || p_partkey % 7 || ' | **Completed:** ' || p_partkey, '', '**Magnet Link:** magnet:?xt=urn:btih:' || infohash) AS page FROM (SELECT *, md5(p_name || p_partkey) AS infohash, CAST(p_partkey AS BIGINT) * p_partkey * p_size * 37 AS n FROM part)"""))
def render_torrents(m: Market):
    """parts as rows of a torrent list, of all orders of size."""
    p, key = m.table("part"), F.col("p_partkey")
    rows = p.select(
        F.md5(F.concat("p_name", key.cast("string")).cast("binary")).alias("infohash"), F.col("p_name").alias("name"), (key.cast("long") * key * F.col("p_size") * 37).alias("size_bytes"),
        F.when(F.col("p_size") % 3 != 0, F.lit(1700000000) + key).alias("created"), F.col("p_size").cast("int").alias("seeders"), (key % 7).cast("int").alias("leechers"), key.cast("int").alias("completed"),
    )
    return rows.select("infohash", D.render_torrent().alias("page"))


@query("render_vulnerabilities", sql("""SELECT c_custkey, concat_ws(chr(10), '# ' || c_name, '', '**Severity:** ' || c_mktsegment || CASE WHEN c_custkey % 4 <> 0 THEN ' (CVSS: ' || (c_custkey % 10) || '.5)' ELSE '' END, '**Published:** 2024', '', '## Description', c_name || ' of ' || c_nationkey, CASE WHEN len(w) > 0 THEN chr(10) || '## Affected Products' || chr(10) || array_to_string(list_transform(w[1:10], lambda x: '- ' || x), chr(10)) || CASE WHEN len(w) > 10 THEN chr(10) || '- ... and ' || (len(w) - 10) || ' more' ELSE '' END END) AS page
    FROM (SELECT c_custkey, c_name, c_nationkey, c_mktsegment, coalesce(list_sort(list(DISTINCT CAST(o_orderkey AS VARCHAR)) FILTER (WHERE o_orderkey IS NOT NULL)), []) AS w FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"""))
def render_vulnerabilities(m: Market):
    """customers as records, their orders as the products."""
    products = m.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_set(F.col("o_orderkey").cast("string"))).alias("products"))
    key = F.col("c_custkey")
    rows = m.table("customer").join(products, "c_custkey", "left").select(
        "c_custkey", F.col("c_name").alias("id"), F.col("c_mktsegment").alias("severity"), F.when(key % 4 != 0, (key % 10).cast("double") + 0.5).alias("base_score"), F.lit("2024").alias("published"),
        F.concat("c_name", F.lit(" of "), F.col("c_nationkey").cast("string")).alias("description"), F.coalesce("products", F.array().cast("array<string>")).alias("products"),
    )
    return rows.select("c_custkey", D.render_vulnerability().alias("page"))


# ---- health counters, forward costs -----------------------------------------------------------------

_REQ = {c: f"({c}_latest_raw_time IS NULL)" for c in M._TH.required}
_IDLE = {c: f"(NOT readiness_eligible AND live AND NOT {g})" if c in ("trade", "candle_5m") else "FALSE" for c, g in _REQ.items()}
_STALE = {c: f"({M._LATE(c)} AND NOT {_IDLE[c]})" for c in _REQ}
_any = lambda tests, *but: " OR ".join(x for c, x in tests.items() if c not in but)
_COUNTERS = f"""SELECT count(*) AS tracked_symbols, count(*) FILTER (WHERE active_recent) AS active_symbols, count(*) FILTER (WHERE readiness_eligible) AS eligible_symbols, count(*) FILTER (WHERE NOT active_recent) AS inactive_symbols, count(*) FILTER (WHERE liveness_class = 'LIVE_SPARSE') AS live_sparse_symbols,
    {', '.join(f"count(*) FILTER (WHERE status = '{x}') AS {x.lower()}_symbols" for x in ('IDLE_LIVE', 'HEALTHY', 'DEGRADED', 'CRITICAL'))},
    count(*) FILTER (WHERE active_recent AND ({_any(_REQ)})) AS symbols_missing_required_channels, count(*) FILTER (WHERE active_recent AND {_STALE['candle_5m']}) AS stale_candle_symbols, count(*) FILTER (WHERE active_recent AND coalesce(feature_lag_seconds > {M._TH.feature_lag}, TRUE)) AS stale_feature_symbols,
    count(*) FILTER (WHERE active_recent AND coverage_ratio < {M._TH.coverage}) AS coverage_fail_symbols, count(*) FILTER (WHERE active_recent AND finalized_ratio < {M._TH.finalized}) AS finalized_fail_symbols,
    count(*) FILTER (WHERE active_recent AND liveness_class <> 'LIVE_SPARSE' AND ((recent_feature_rows_24h > 0 AND recent_execution_observed_share_24h < {M._TH.execution_observed}) OR {_any(_REQ, 'candle_5m')} OR {_any(_STALE, 'candle_5m')} OR (NOT readiness_eligible AND status <> 'IDLE_LIVE'))) AS execution_fail_symbols,
    {rr('coalesce(avg(coverage_ratio) FILTER (WHERE active_recent), 0) AS avg_coverage_ratio_active', 'coalesce(avg(finalized_ratio) FILTER (WHERE active_recent), 0) AS avg_finalized_ratio_active', 'coalesce(avg(recent_execution_observed_share_24h) FILTER (WHERE active_recent), 0) AS avg_recent_execution_observed_share_24h_active')},
    CAST(coalesce(max(coalesce(candle_5m_raw_lag_seconds, 0)) FILTER (WHERE active_recent), 0) AS BIGINT) AS max_candle_lag_seconds_active, CAST(coalesce(max(coalesce(feature_lag_seconds, 0)) FILTER (WHERE active_recent), 0) AS BIGINT) AS max_feature_lag_seconds_active,
    coalesce((SELECT string_agg(symbol, ',' ORDER BY candle_5m_raw_lag_seconds DESC NULLS FIRST, exchange, symbol) FROM (SELECT * FROM e3 WHERE status = 'CRITICAL' ORDER BY candle_5m_raw_lag_seconds DESC NULLS FIRST, exchange, symbol LIMIT 12)), '') AS critical_sample FROM e3"""


@query("health_counters", sql(_COUNTERS, "sync", "b5", extra=M._EVAL))
def health_counters(m: Market):
    """A34 in full, the critical sample included."""
    found = H.counters(stored(H.evaluate(M._symbols(m), M._TH), "health"), M._TH)
    return rounded(found.withColumn("critical_sample", F.array_join("critical_sample", ",")))


_clip = lambda x, lo, hi: f"least(greatest({x}, {lo}), {hi})"
_FORWARD = {
    "fw": f"SELECT time, symbol, exchange, spread_pct, mid_price, funding_rate, coalesce(bid_depth_10, 0) + coalesce(ask_depth_10, 0) AS depth, coalesce(close / nullif(lag(close) OVER ({_WX}), 0) - 1, 0) AS ret, (bid_depth_10 - ask_depth_10) / nullif(bid_depth_10 + ask_depth_10, 0) AS alpha FROM b5",
    "fx": f"SELECT *, coalesce(alpha, 0) AS ma, greatest(coalesce(spread_pct, 0), 0) * 100 AS sp, CASE WHEN count(ret) OVER ({_WX} ROWS 9 PRECEDING) = 10 THEN avg(ret) OVER ({_WX} ROWS 9 PRECEDING) END AS r10 FROM fw",
    "fy": f"""SELECT *, CASE WHEN abs(ma) > 0.35 THEN 4.5 ELSE 1.5 END AS fee_bps, sp AS spread_cost_bps, {_clip('1.5 + sp * 0.25 + abs(ret) * 7000', 0.2, 30)} AS slippage_bps, {_clip('coalesce(0.6 + 1000.0 / nullif(depth * mid_price, 0) * 12, 2.0)', 0.3, 18)} AS impact_bps, {_clip('0.8 + abs(ma) * 3.5', 0.4, 8)} AS adverse_selection_bps,
        {_clip('-coalesce(funding_rate, 0) * 10000 * 15 / 60.0', -5, 5)} AS funding_drift_bps, {_clip('coalesce(r10, 0) * 1000', -5, 5)} AS basis_drift_bps FROM fx""",
    "fz": "SELECT *, fee_bps + spread_cost_bps + slippage_bps + impact_bps + adverse_selection_bps + funding_drift_bps + basis_drift_bps AS total_cost_bps FROM fy",
}
_PARTS = ["fee_bps", "spread_cost_bps", "slippage_bps", "impact_bps", "adverse_selection_bps", "funding_drift_bps", "basis_drift_bps", "total_cost_bps"]


@query("forward_costs", sql(f"SELECT time, symbol, exchange, {rr(*_PARTS, _clip('ma * 10', -25, 25) + ' - total_cost_bps AS edge_after_cost_bps', _clip('0.92 - sp / 200 - abs(ma) * 0.08', 0.35, 1) + ' AS fill_ratio', '1000.0 * abs(fee_bps) / 10000 AS estimated_fee_usd', '1000.0 * abs(total_cost_bps) / 10000 AS estimated_cost_usd', digits=5)} FROM fz", "b5", extra=_FORWARD))
def forward_costs(m: Market):
    """all seven components on the five-minute bars."""
    w = Window.partitionBy("symbol", "exchange").orderBy("time")
    last, ten = F.lag("close").over(w), w.rowsBetween(-9, 0)
    bid, ask = F.col("bid_depth_10"), F.col("ask_depth_10")
    df = m.bars_5m.withColumns({"ret": F.coalesce(F.try_divide(F.col("close"), last) - 1.0, F.lit(0.0)), "micro_alpha": F.coalesce(F.try_divide(bid - ask, bid + ask), F.lit(0.0)), "depth": F.coalesce(bid, F.lit(0.0)) + F.coalesce(ask, F.lit(0.0)), "spread_pct": F.coalesce("spread_pct", F.lit(0.0))})
    df = df.withColumn("recent", F.when(F.count("ret").over(ten) == 10, F.avg("ret").over(ten)))
    out = C.forward_costs(df, recent_return=F.col("recent"))
    return rounded(out.select("time", "symbol", "exchange", *_PARTS, "edge_after_cost_bps", "fill_ratio", "estimated_fee_usd", "estimated_cost_usd"), 5)


@query("book_fallback", sql("SELECT symbol, exchange, max(time) AS time, arg_max(best_bid, time) AS best_bid, arg_max(best_ask, time) AS best_ask, round((arg_max(best_bid, time) + arg_max(best_ask, time)) / 2, 6) + 0.0 AS mid_price FROM books WHERE CASE WHEN exchange = 'ex0' AND symbol IN ('click', 'view') THEN TRUE ELSE time < TIMESTAMP '2024-01-10' END GROUP BY 1, 2", "books"))
def book_fallback(m: Market):
    """IO5: two symbols with current books, the others with a legacy table that ends earlier."""
    live = m.books.filter("exchange = 'ex0'")
    legacy = m.books.filter("time < TIMESTAMP '2024-01-10'").select("symbol", "exchange", "time", F.col("best_bid").alias("bid_price"), F.col("best_ask").alias("ask_price"))
    minute = live.filter("symbol = 'click'").withColumn("last_event_time", F.col("time"))
    return rounded(io.current_books(minute, live.filter("symbol IN ('click', 'view')"), legacy, ["symbol", "exchange"], ["best_bid", "best_ask", "mid_price"]))


# ---- small rules -----------------------------------------------------------------------------------


@query("exchange_alias", sql("SELECT symbol, count(*) AS trades FROM trades WHERE exchange IN ('ex1', 'exchange-one') GROUP BY 1", "trades"))
def exchange_alias(m: Market):
    """P8."""
    return U.aliases(m.trades, ["ex1", "exchange-one"]).groupBy("symbol").agg(F.count("*").alias("trades"))


@query("squashed", f"SELECT c_custkey, {rr('x / 2000 / sqrt(1 + x / 2000 * x / 2000) AS squashed', '1 / (1 + exp(-x / 1000)) AS logistic')} FROM (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS x FROM customer)")
def squashed(m: Market):
    """F7."""
    x = F.col("c_acctbal").cast("double")
    return rounded(m.table("customer").select("c_custkey", K.squash(x, 2000.0).alias("squashed"), K.logistic(x / 1000.0).alias("logistic")))


_LINKED = "SELECT symbol, source, time_bucket(INTERVAL '1 hour', observed_at) AS observed_at, CASE WHEN confidence > 0.5 THEN 'u' || CAST(floor(confidence * 10) AS INTEGER) % 3 END AS article_url FROM sentiment"


@query("sentiment_unique", sql("SELECT DISTINCT source, symbol, observed_at, coalesce(article_url, '') AS url FROM li", "sentiment", extra={"li": _LINKED}))
def sentiment_unique(m: Market):
    """K3: by source, symbol, hour and link, a missing link being the empty one."""
    rows = m.sentiment.select("symbol", "source", F.date_trunc("hour", "observed_at").alias("observed_at"), F.when(F.col("confidence") > 0.5, F.concat(F.lit("u"), (F.floor(F.col("confidence") * 10) % 3).cast("string"))).alias("article_url"), F.lit(None).cast("string").alias("article_title"))
    return S.sentiment_unique(rows).select("source", "symbol", "observed_at", F.coalesce("article_url", F.lit("")).alias("url"))


@query("audience", sql("SELECT id, kind AS content_type FROM (SELECT id, CASE source WHEN 'web' THEN 'article' WHEN 'forum' THEN 'code' ELSE CASE WHEN length(source) % 2 = 0 THEN 'documentation' ELSE 'vulnerability' END END AS kind FROM staging) WHERE kind IN ('code', 'documentation', 'vulnerability')", "staging"))
def audience(m: Market):
    """Documents fit for agents, by a content type of their source."""
    source = F.col("source")
    kind = F.when(source == "web", "article").when(source == "forum", "code").when(F.length(source) % 2 == 0, "documentation").otherwise("vulnerability")
    return D.audience(m.staging.withColumn("content_type", kind), "agent").select("id", "content_type")


@query("trade_page", sql("SELECT trade_id, time, price, CASE WHEN lower(side) IN ('buy', 'b') THEN 'buy' ELSE 'sell' END AS side FROM trades WHERE symbol = 'click' AND time >= TIMESTAMP '2024-01-10' AND time <= TIMESTAMP '2024-01-20' ORDER BY time DESC LIMIT 100", "trades"))
def trade_page(m: Market):
    """IO3: the newest hundred trades of a symbol in a range."""
    at = lambda d: F.lit(d).cast("timestamp")
    return io.newest(m.trades, "click", at("2024-01-10"), at("2024-01-20"), 100).select("trade_id", "time", "price", io.side_of(F.col("side")).alias("side"))
