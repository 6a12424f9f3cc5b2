"""Hand-computed values, brute-force twins and invariants."""

import math
from datetime import datetime, timedelta
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.functions import constants, stats
from tickloom.operators import async_cov, inference, jumps, liquidity, matrix, models, noise, panel, realized, spot
from tickloom.sources import tables

START = datetime(2024, 1, 1)


def make_ticks(spark, prices_by_symbol, times=None):
    rows = []
    for k, (symbol, prices) in enumerate(prices_by_symbol.items()):
        for i, p in enumerate(prices):
            hours = times[symbol][i] if times else i
            rows.append((symbol, "2024-01-01", START + timedelta(hours=float(hours)), 1000 * k + i, float(p)))
    return spark.createDataFrame(rows, tables.TICKS)


def prices_of(n, seed=0):
    rng = np.random.default_rng(seed)
    return (100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))).tolist()


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_doc_example(spark):
    row = one(realized.realized(make_ticks(spark, {"a": [100, 101, 100.5, 102]}), ["rrvar", "rbpvar"]))
    r = np.diff(np.log([100, 101, 100.5, 102]))
    assert row.rrvar == pytest.approx((r**2).sum())
    assert row.rbpvar == pytest.approx(math.pi / 2 * (abs(r[1:]) * abs(r[:-1])).sum())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_short_series(spark, n):
    row = one(realized.realized(make_ticks(spark, {"a": prices_of(n)}), list(realized.MEASURES)))
    assert row.n == n - 1
    assert (row.rmedrvar > 0) == (n >= 4) and (row.rqpvar > 0) == (n >= 5) and (row.rminrvar > 0) == (n >= 3)


def test_constant_prices_and_bad_rows(spark):
    row = one(realized.realized(make_ticks(spark, {"a": [5.0] * 6}), list(realized.MEASURES)))
    assert all(row[m] == 0 for m in realized.MEASURES)
    raw = spark.createDataFrame([(1, START, "x", 2.0), (2, START, "x", None), (3, START, "x", -1.0), (4, START, "x", float("nan"))], "event_id long, ts timestamp_ntz, event_type string, value double")
    assert tables.as_ticks(raw, "event_type", "ts", "event_id", "value").count() == 1


def test_unknown_names_raise(spark):
    ticks = make_ticks(spark, {"a": prices_of(9)})
    for call in (lambda: realized.realized(ticks, ["nope"]), lambda: realized.multipower(ticks, 1, 2), lambda: constants.kernel_id("epanechnikov"), lambda: jumps.bns(ticks, "nope"), lambda: models.har_design(ticks, "nope")):
        with pytest.raises(ValueError):
            call()


def test_semivariances_add_up(spark):
    row = one(realized.realized(make_ticks(spark, {"a": prices_of(60)}), ["rrvar", "rsvar_down", "rsvar_up"]))
    assert row.rsvar_down + row.rsvar_up == pytest.approx(row.rrvar)


def test_multipower_is_scaled_bipower(spark):
    ticks = make_ticks(spark, {"a": prices_of(40)})
    n = 39
    assert one(noise_free := realized.multipower(ticks)).rmpvar == pytest.approx(n / (n - 1) * one(realized.realized(ticks, ["rbpvar"])).rbpvar), noise_free


def test_two_scale_by_grids(spark):
    p = prices_of(57)
    lp, k, n = np.log(p), 5, 57
    s = {m: sum((lp[i + m] - lp[i]) ** 2 for g in range(m) for i in range(g, n - m, m)) for m in (k, 1)}
    q = ((n - k) / k) / (n - 1)
    assert one(noise.two_scale(make_ticks(spark, {"a": p}), k, 1)).rtsvar == pytest.approx((s[k] / k - q * s[1]) / (1 - q))


def test_modulated_by_loops(spark):
    p = prices_of(50)
    r, n = np.diff(np.log(p)), 50
    kn = max(2, int(0.8 * math.sqrt(n)))
    g = np.array([min(j / kn, 1 - j / kn) for j in range(kn + 1)])
    pa = np.array([(r[i : i + kn] * g[:kn]).sum() / g[:kn].sum() for i in range(len(r) - kn + 1)])
    psi1, psi2 = kn * (np.diff(g) ** 2).sum(), (g[:kn] ** 2).sum() / kn
    want = (pa**2).sum() / (math.sqrt(n) * 0.8 * psi2) - psi1 / (2 * 0.64 * psi2 * n) * (r**2).sum()
    assert one(noise.modulated(make_ticks(spark, {"a": p}))).rmrvar == pytest.approx(want)


def test_kernels(spark):
    ticks = make_ticks(spark, {"a": prices_of(30)})
    assert one(noise.realized_kernel(ticks, "parzen", 0)).rkernelvar == pytest.approx(one(realized.realized(ticks, ["rrvar"])).rrvar)
    for names in constants.KERNEL_NAMES.values():
        assert constants.kernel_weight(0.0, names[0]) == pytest.approx(1.0)
    assert constants.kernel_weight(1.0, "7th") == pytest.approx(1) and constants.kernel_weight(1.0, "8th") == pytest.approx(9)
    assert constants.kernel_id("Tukey-Hanning") == "tukey" and constants.kernel_id("flat_top") == "flattop"


def test_overlap_sums_equal_double_loop(spark):
    rng = np.random.default_rng(3)
    times = {"a": np.sort(rng.choice(200, 25, False)) / 10, "b": np.sort(rng.choice(200, 31, False)) / 10 + 0.05}
    p = {"a": prices_of(25, 1), "b": prices_of(31, 2)}
    r = {s: np.diff(np.log(p[s])) for s in p}

    def loop(lag):
        return sum(r["a"][i] * r["b"][j] for i in range(24) for j in range(30) if times["a"][i] < times["b"][j + 1] + lag and times["b"][j] + lag < times["a"][i + 1])

    ticks = make_ticks(spark, p, times)
    got = {x.lag: x.covariance for x in async_cov.shifted_covariances(ticks, 2).collect()}
    assert got == pytest.approx({lag: loop(lag) for lag in range(-2, 3)})
    off = [x.rhycov for x in async_cov.overlap_covariance(ticks).collect() if x.sym_i != x.sym_j]
    assert off == pytest.approx([got[0]])


def test_same_clock_overlap_is_covariance(spark):
    p = {"a": prices_of(20, 1), "b": prices_of(20, 2)}
    ticks = make_ticks(spark, p)
    want = (np.diff(np.log(p["a"])) * np.diff(np.log(p["b"]))).sum()
    assert [x.rhycov for x in async_cov.overlap_covariance(ticks).collect() if x.sym_i != x.sym_j] == pytest.approx([want])


def test_disjoint_spans(spark):
    ticks = make_ticks(spark, {"a": prices_of(5), "b": prices_of(5, 2)}, {"a": range(5), "b": range(10, 15)})
    assert [x.rhycov for x in async_cov.overlap_covariance(ticks).collect() if x.sym_i != x.sym_j] == [0.0]


def walk_refresh(t1, t2):
    """One step at a time, by the definition."""
    out, now = [], None
    while True:
        after = [[t for t in ts if now is None or t > now] for ts in (t1, t2)]
        if not all(after):
            return out
        now = max(after[0][0], after[1][0])
        if now > min(t1[-1], t2[-1]):
            return out
        out.append(now)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1, max_size=30), st.sets(st.integers(0, 60), min_size=1, max_size=30))
def test_refresh_times(a, b):
    t1, t2 = (np.array(sorted(x), float) for x in (a, b))
    assert async_cov.refresh_times(t1, t2).tolist() == walk_refresh(t1.tolist(), t2.tolist())


def test_two_scale_forms_agree(spark):
    ticks = make_ticks(spark, {"a": prices_of(40, 1), "b": prices_of(40, 2)})
    a, b = (sorted(map(tuple, f(ticks, 5, 1).collect())) for f in (async_cov.two_scale_covariance, async_cov.robust_two_scale_covariance))
    assert a == b


def make_panel(spark, k=3, n=40, seed=0):
    r = np.random.default_rng(seed).normal(0, 1, (n, k))
    return spark.createDataFrame([("d", i + 1, "abcdef"[j], float(r[i, j])) for i in range(n) for j in range(k)], "day string, idx int, symbol string, r double"), r


def as_matrix(df, value, k=3):
    m = np.zeros((k, k))
    for x in df.collect():
        i, j = "abcdef".index(x.sym_i), "abcdef".index(x.sym_j)
        m[i, j] = m[j, i] = x[value]
    return m


def test_panel_family(spark):
    p, r = make_panel(spark)
    assert as_matrix(panel.covariance(p), "rcov") == pytest.approx(r.T @ r)
    semi = panel.semi_covariance(p)
    parts = [as_matrix(semi, c) for c in ("positive", "negative", "mixed", "rcov")]
    assert parts[0] + parts[1] + parts[2] == pytest.approx(parts[3])
    med = np.median(r, 0)
    dev = np.abs(r - med)
    d = ((dev / (np.median(dev, 0) * 1.4826 + 1e-10)) ** 2).sum(1)
    w = np.where(d > 9, 9 / d, 1)
    assert as_matrix(panel.weighted_covariance(p), "rowcov") == pytest.approx((r * w[:, None]).T @ r / w.sum() * len(r))
    total = np.zeros((3, 3))
    n0 = (40 - 2) // 3
    for off, main in ((2, True), (1, False), (2, False)):
        x = np.diff(r[off::3], axis=0)
        total += x.T @ x * (1 if main else n0 / ((40 - off) // 3))
    assert as_matrix(panel.averaged_covariance(p, 3), "ravgcov") == pytest.approx(total / 3)
    assert as_matrix(panel.threshold_covariance(p, 1e9), "rthresholdcov") == pytest.approx(r.T @ r)


def test_make_psd(spark):
    bad = np.array([[1.0, 2.0, 0.5], [2.0, 1.0, 0.1], [0.5, 0.1, 1.0]])
    rows = [("d", "abc"[i], "abc"[j], float(bad[i, j])) for i in range(3) for j in range(i, 3)]
    out = as_matrix(matrix.make_psd(spark.createDataFrame(rows, "day string, sym_i string, sym_j string, v double"), "v"), "v")
    assert np.linalg.eigvalsh(out).min() >= 0.9e-6 and out == pytest.approx(matrix.project(bad))


def test_jump_is_found_and_forms(spark):
    p = prices_of(80, 5)
    p[50:] = [x * 3 for x in p[50:]]
    ticks = make_ticks(spark, {"a": p})
    found = [x.idx for x in jumps.intraday(ticks, alpha=0.5).collect() if x.stat == max(y.stat for y in jumps.intraday(ticks, alpha=0.5).collect())]
    assert found == [49]
    assert one(jumps.bns(ticks, "RV")).ztest == 0 and one(jumps.bns(ticks, log_transform=True)).ztest == 0
    row = one(inference.iv_inference(ticks))
    assert row.lower <= row.iv <= row.upper


def test_one_return_has_no_local_test(spark):
    assert [x.critical_value for x in jumps.intraday(make_ticks(spark, {"a": [1, 2]})).collect()] == [None]


def test_returns_as_input(spark):
    p = prices_of(30)
    rows = [("a", "2024-01-01", START + timedelta(hours=i), i, float(r)) for i, r in enumerate(np.diff(np.log(p)))]
    returns = spark.createDataFrame(rows, "symbol string, day string, ts timestamp_ntz, seq long, r double")
    ticks = make_ticks(spark, {"a": p})
    for f in (lambda t: realized.realized(t, list(realized.MEASURES)), lambda t: noise.realized_kernel(t, "qs", 3), realized.multipower, jumps.aj, noise.modulated):
        assert list(one(f(returns)))[2:] == pytest.approx(list(one(f(ticks)))[2:])


def test_spot_windows(spark):
    p = prices_of(30)
    r = np.diff(np.log(p))
    got = sorted((x.idx, x.spotvol) for x in spot.spot_vol(make_ticks(spark, {"a": p}), 6).collect())
    assert [v for _, v in got] == pytest.approx([math.sqrt((r[max(0, i - 3) : i + 4] ** 2).sum()) for i in range(29)])


def test_trade_direction_carries(spark):
    rows = [("d", START + timedelta(seconds=i), i, p, 9.0, 11.0) for i, p in enumerate([10.0, 10.0, 10.5, 10.0, 10.0, 9.5, 10.0])]
    df = spark.createDataFrame(rows, "day string, ts timestamp_ntz, seq long, price double, bid double, ask double")
    directed = liquidity.trade_direction(df)
    assert [x.direction for x in directed.orderBy("seq").collect()] == [0, 0, 1, -1, -1, -1, 1]
    s = one(liquidity.direction_summary(directed))
    assert s.n_buys + s.n_sells + s.n_unknown == 7


def test_normal_and_t(spark):
    z = [0.0, 0.5, 1.0, 1.96, 3.0, 6.0, 7.5, 12.0, 40.0, -2.0]
    got = [x.p for x in spark.createDataFrame([(float(x),) for x in z], "z double").select(stats.two_sided_p("z").alias("p")).collect()]
    assert got == pytest.approx([math.erfc(abs(x) / math.sqrt(2)) for x in z], rel=1e-7, abs=1e-15)
    for t, df in ((2.0, 10), (1.0, 1), (3.5, 30)):
        x = np.linspace(0, t, 200_001)
        density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
        assert stats.t_two_sided(t, df) == pytest.approx(1 - 2 * np.trapezoid(density, x), abs=1e-9)
    assert constants.normal_quantile(0.975) == NormalDist().inv_cdf(0.975) and constants.mu_p(2) == pytest.approx(1)


def make_daily(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    rv = np.exp(rng.normal(0, 0.4, n))
    pdf = pd.DataFrame({"symbol": "s", "day": [f"{i:05d}" for i in range(n)], "ret": rng.normal(0, np.sqrt(rv)), "rv": rv, "bpv": rv * rng.uniform(0.7, 1.1, n), "tq": rv**2})
    return spark.createDataFrame(pdf), pdf


def test_har_fits(spark):
    df, pdf = make_daily(spark)
    beta = {x.term: x.coefficient for x in models.fit_har(df, "HAR").collect()}
    assert beta["daily"] == pytest.approx(1) and beta["weekly"] == pytest.approx(0, abs=1e-8)
    avg = {k: pdf.bpv.rolling(k).mean() for k in (1, 5, 22)}
    x = np.column_stack([np.ones(300), *avg.values()])[22:]
    want = np.linalg.lstsq(x, pdf.rv.to_numpy()[22:], rcond=None)[0]
    got = {r.term: r.coefficient for r in models.fit_har(df, "CHAR").collect()}
    assert [got[k] for k in ("const", "daily", "weekly", "monthly")] == pytest.approx(want.tolist())


def test_heavy(spark):
    x = np.abs(np.random.default_rng(1).normal(1, 0.3, 200))
    par = np.array([0.1, 0.3, 0.5])
    h = [x.mean()]
    for v in x[:-1]:
        h.append(0.1 + 0.3 * v + 0.5 * h[-1])
    assert models.recursion(par, x) == pytest.approx(np.array(h))
    df, pdf = make_daily(spark)
    got = [r.h for r in models.heavy_filter(df, "rv", 0.1, 0.3, 0.5).orderBy("day").collect()]
    assert got == pytest.approx(models.recursion(par, pdf.rv.to_numpy()).tolist())
    best, ll = models.maximise(pdf.rv.to_numpy())
    assert ll >= models.log_likelihoods(par, pdf.rv.to_numpy()).sum() and (best >= models.LOWER).all()
    fits = [sorted(map(tuple, models.fit_heavy(df).collect())) for _ in range(2)]
    assert fits[0] == fits[1] and len(fits[0]) == 6


def test_empty_tables(spark):
    ticks = spark.createDataFrame([], tables.TICKS)
    for f in (lambda t: realized.realized(t, ["rrvar"]), noise.two_scale, noise.modulated, jumps.intraday, async_cov.overlap_covariance, async_cov.refresh_sync, spot.drift_bursts):
        assert f(ticks).count() == 0


def test_plan_has_one_shuffle_and_pushdown(spark):
    plan = realized.realized(tables.ticks(spark, "/root/testdata/sf0.001"), ["rrvar", "rbpvar", "rtpquar"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "GreaterThan(value,0.0)" in plan and "props" not in plan


def test_refresh_panel_of_three_clocks(spark):
    prices = {"a": prices_of(5), "b": prices_of(4, 1), "c": prices_of(3, 2)}
    ticks = make_ticks(spark, prices, {"a": [0, 1, 2, 3, 4], "b": [0.5, 1.5, 3.5, 4.5], "c": [1, 3, 4]})
    for variant, picks in (("faithful", [(0, 0, 0), (2, 1, 0), (3, 2, 1)]), ("literature", [(1, 0, 0), (3, 1, 1), (4, 2, 2)])):
        rows = sorted(async_cov.refresh_panel(ticks, variant).collect(), key=lambda r: r.m)
        assert [r.t - rows[0].t for r in rows] == pytest.approx([0, 2, 3])
        assert all(r.symbols == ["a", "b", "c"] for r in rows)
        for r, at in zip(rows, picks, strict=True):
            assert r.lps == pytest.approx([math.log(prices[k][i]) for k, i in zip("abc", at)])


def test_order_of_tied_rows_does_not_count(spark):
    rng = np.random.default_rng(4)
    times = {"a": [0, 1, 1, 2, 2, 4, 5], "b": [0, 1, 1, 1, 3, 4, 4]}
    ticks = make_ticks(spark, {"a": prices_of(7, 1), "b": prices_of(7, 2)}, times)
    rows = ticks.collect()
    last = {}
    for r in rows:
        last[r.symbol, r.ts] = max(last.get((r.symbol, r.ts), r), r, key=lambda x: x.seq)
    single = spark.createDataFrame(list(last.values()), tables.TICKS)
    for f in (lambda t: async_cov.shifted_covariances(t, 2), async_cov.lead_lag, async_cov.refresh_sync, async_cov.refresh_panel, lambda t: async_cov.overlap_covariance(t).filter("sym_i != sym_j")):
        want = sorted(map(repr, f(single).collect()))
        for _ in range(2):
            mixed = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], tables.TICKS)
            assert sorted(map(repr, f(mixed).collect())) == want
    day = {"day": "d"}
    quotes = [(day["day"], START, 1, 9.0, 11.0), (day["day"], START, 2, 19.0, 21.0), (day["day"], START, 3, 14.0, 15.0)]
    trades = spark.createDataFrame([("d", START, 9, 10.0)], "day string, ts timestamp_ntz, seq long, price double")
    for order in ([0, 1, 2], [2, 1, 0], [1, 2, 0]):
        q = spark.createDataFrame([quotes[i] for i in order], "day string, ts timestamp_ntz, seq long, bid double, ask double")
        assert one(liquidity.asof_quotes(trades, q)).bid == 14.0
        assert one(liquidity.asof_quotes(trades, q.drop("seq"))).bid == 19.0


def test_har_and_heavy_values(spark):
    df, pdf = make_daily(spark)
    for model in ("CHAR", "CHARQ", "HARJ"):
        beta = [r.coefficient for r in models.fit_har(df, model).collect()]
        design = models.har_design(df, model).toPandas().sort_values("day")
        x = np.column_stack([np.ones(len(design)), design.daily, design.weekly, design.monthly, *([design.extra] if len(beta) == 5 else [])]).astype(float)
        got = models.har_values(df, model).toPandas().sort_values("day")
        assert got.fitted.tolist() == pytest.approx((x @ beta).tolist()) and (got.fitted + got.residual).tolist() == pytest.approx(design.y.tolist())
    est = {(r.equation, r.param): r.estimate for r in models.fit_heavy(df).collect()}
    paths = models.heavy_paths(df).toPandas().sort_values("day")
    for column, equation, x in (("conditional_variance", "variance", pdf.ret.to_numpy() ** 2), ("conditional_mean", "rm", pdf.rv.to_numpy())):
        par = np.array([est[equation, p] for p in ("omega", "alpha", "beta")])
        assert paths[column].tolist() == pytest.approx(models.recursion(par, x).tolist())
    lone = {(r.equation, r.param): r.log_likelihood for r in models.fit_heavy(df, rm_starting=(0.2, 0.2, 0.5), multi_start=False).collect()}
    assert lone["rm", "alpha"] <= max(r.log_likelihood for r in models.fit_heavy(df).collect() if r.equation == "rm") + 1e-6
    assert models.heavy_paths(df.limit(2)).count() == 0


def test_symbols_that_tick_at_one_time_refresh_once(spark):
    """Values of the reference's loop by hand: one row for the tied time, both values from strictly before it, and
    the next refresh waits for a later tick of each."""
    at = lambda s: START + timedelta(seconds=s)
    rows = [("a", at(1), 1, 10.0), ("b", at(2), 2, 20.0), ("a", at(4), 3, 11.0), ("b", at(4), 4, 21.0), ("a", at(5), 5, 12.0), ("b", at(7), 6, 22.0), ("a", at(8), 7, 13.0), ("b", at(9), 8, 23.0)]
    ticks = spark.createDataFrame([(s, "2024-01-01", t, n, p) for s, t, n, p in rows], tables.TICKS)
    got = sorted(async_cov.refresh_sync(ticks).collect(), key=lambda r: r.m)
    hours = [r.t * 3600 for r in got]
    assert [r.m for r in got] == [0, 1, 2] and np.allclose(np.array(hours) - hours[0], [0, 2, 5], atol=1e-4)
    assert np.allclose([(r.lp_i, r.lp_j) for r in got], np.log([(10, 20), (10, 20), (12, 21)]))
