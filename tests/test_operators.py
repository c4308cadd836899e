"""Operators against small versions of their own, and their edges."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from driftwell.functions import distributions
from driftwell.operators import backtest, blocks, cleaning, efficiency, joins, rolling
from driftwell.operators import inference as inf
from driftwell.operators.regimes import dating, garch, hmm, jump, segments
from driftwell.sources.panel import write_table
from pyspark.sql import functions as F

DAY = dt.date(2020, 1, 1)


def panel(spark, series, column="ret"):
    rows = [(s, DAY + dt.timedelta(days=i), None if v is None else float(v)) for s, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"series_id string, ts date, {column} double")


def noise(n, seed=1):
    return np.random.default_rng(seed).standard_normal(n)


def values(df, column, series="a"):
    return [r[column] for r in df.where(F.col("series_id") == series).orderBy("ts").collect()]


def test_distributions():
    assert distributions.normal_cdf(1.959963984540054) == pytest.approx(0.975)
    assert distributions.student_cdf(2.228138852, 10) == pytest.approx(0.975, abs=1e-8)
    assert distributions.student_cdf(1.0, 1) == pytest.approx(0.75, abs=1e-10)
    assert distributions.student_cdf(-3.0, 4) == pytest.approx(1 - distributions.student_cdf(3.0, 4))


def test_split_mask_and_nulls(spark):
    df = cleaning.split_mask(panel(spark, {"a": [None, -0.5, 0.1, 1.0, 0.7]}))
    assert values(df, "ret") == [None, None, 0.1, None, 0.7]


def test_constant_and_short_series_give_null(spark):
    df = panel(spark, {"a": [1.0] * 80, "b": [1.0, 2.0]})
    out = rolling.ljung_box(rolling.variance_ratio(df, "ret"), "ret")
    assert values(out, "vr") == [None] * 80
    assert values(out, "lb_q")[-1] == 0.0
    assert values(out, "lb_q", "b") == [None, None]
    assert values(efficiency.rolling_hurst(df, n=40), "hurst", "b") == [None, None]


def test_variance_ratio_directly(spark):
    x = noise(90)
    got = values(rolling.variance_ratio(panel(spark, {"a": x}), "ret", 60, 5), "vr")
    w = x[30:]
    q = np.convolve(w, np.ones(5), "valid")
    assert got[-1] == pytest.approx(q.var(ddof=1) / (5 * w.var(ddof=1)))
    assert got[58] is None and got[59] is not None


def test_hurst_directly_and_in_any_blocks(spark):
    x = noise(300)
    df = panel(spark, {"a": x})
    one, two = (values(efficiency.rolling_hurst(df, n=100, block=b), "hurst") for b in (32, 4096))
    assert one == two

    def direct(w):
        pts = []
        for lag in range(10, min(len(w) // 2, 100), max(1, len(w) // 40)):
            rs = []
            for i in range(0, len(w) - lag, lag):
                c = w[i : i + lag]
                d = np.cumsum(c - c.mean())
                rs.append((d.max() - d.min()) / c.std(ddof=1))
            pts.append((math.log(lag), math.log(np.mean(rs))))
        return np.polyfit(*zip(*pts), 1)[0]

    assert one[-1] == pytest.approx(direct(x[-100:]))


@pytest.mark.parametrize("size", [16, 10_000])
def test_blocks_do_not_change_results(spark, size):
    x = [None if i % 17 == 3 else v for i, v in enumerate(noise(120))]
    df = panel(spark, {"a": x, "b": noise(50, 2)})
    f = lambda p: p.withColumn("m", rolling.rolling_std("ret", 20, 10))
    want = {(r.series_id, r.ts): r.m for r in f(df).collect()}
    got = {(r.series_id, r.ts): r.m for r in blocks.in_blocks(df, 19, f, size).collect()}
    assert got == pytest.approx(want)
    s = pd.Series(noise(50, 2))
    e = values(blocks.ewma(df, "ret", "e", alpha=0.1, size=size), "e", "b")
    assert e == pytest.approx(s.ewm(alpha=0.1, adjust=False).mean().tolist())
    h = values(blocks.ewma(df, "ret", "e", half_life=5, size=size), "e", "b")
    assert h == pytest.approx(s.ewm(halflife=5).mean().tolist())


def test_the_future_changes_no_past(spark):
    x = noise(120)
    a = values(rolling.ljung_box(panel(spark, {"a": x}), "ret"), "lb_q")[:90]
    b = values(rolling.ljung_box(panel(spark, {"a": x[:90]}), "ret"), "lb_q")
    assert a[59:] == pytest.approx(b[59:])
    one, two = (jump.online(np.abs(x[:n, None] - np.array([0.0, 2.0])), 1.0) for n in (120, 90))
    assert (one[:90] == two).all()


def test_as_of(spark):
    left = spark.createDataFrame([(DAY + dt.timedelta(days=i),) for i in (0, 5, 10)], "ts date")
    right = spark.createDataFrame([(DAY + dt.timedelta(days=5), 1.0), (DAY + dt.timedelta(days=7), None), (DAY + dt.timedelta(days=20), 3.0)], "ts date, v double")
    assert [r.v for r in joins.as_of(left, right, "v").orderBy("ts").collect()] == [None, 1.0, 1.0]
    assert [r.v for r in joins.as_of(left, right, "v", strict=True).orderBy("ts").collect()] == [None, None, 1.0]


def test_spells_and_detection(spark):
    rows = [("a", DAY + dt.timedelta(days=i), t, l) for i, (t, l) in enumerate(zip([0, 1, 1, 1, 0, 1, 1, 0, 1], [0, 1, 1, 0, 0, 0, 1, 0, 0]))]
    df = spark.createDataFrame(rows, "series_id string, ts date, truth int, label int")
    assert [(r.label, r.n) for r in rolling.spells(df, "truth").orderBy("start").collect()] == [(0, 1), (1, 3), (0, 1), (1, 2), (0, 1), (1, 1)]
    got = rolling.detection(df).first()
    assert (got.n_spells, got.median_delay, got.missed) == (3, 0.5, pytest.approx(1 / 3))


def test_auc_with_ties(spark):
    rng = random.Random(3)
    rows = [("g", rng.randint(0, 4), rng.randint(0, 1)) for _ in range(60)]
    got = inf.auc(spark.createDataFrame(rows, "g string, s int, y int"), "s", "y", ["g"]).first().auc
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    assert got == pytest.approx(sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg))


def test_benjamini_hochberg(spark):
    p = [0.001, 0.04, 0.012, 0.013, 0.2, 0.5, 0.03, 0.031]
    df = inf.benjamini_hochberg(spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "f string, i int, p double"), "p", ["f"])
    got = {r.i: (r.adjusted_p, r.reject) for r in df.collect()}
    order = np.argsort(p)
    raw = np.array(p)[order] * 8 / np.arange(1, 9)
    want = np.minimum.accumulate(raw[::-1])[::-1]
    for k, i in enumerate(order):
        assert got[i][0] == pytest.approx(min(1, want[k]))
        assert got[i][1] == (want[k] <= 0.05)


def test_regression_errors(spark):
    rng = np.random.default_rng(4)
    x, e = rng.standard_normal(200), rng.standard_normal(200)
    y = 1 + 2 * x + e * (1 + x * x)
    df = spark.createDataFrame([("g", float(a), float(b), 1.0) for a, b in zip(x, y)], "g string, x double, y double, one double")
    got = {r.term: (r.coef, r.t) for r in inf.ols_hc0(df, "y", ["one", "x"], ["g"]).collect()}
    m = np.column_stack([np.ones(200), x])
    inv = np.linalg.inv(m.T @ m)
    beta = inv @ m.T @ y
    se = np.sqrt(np.diag(inv @ (m.T * (y - m @ beta) ** 2) @ m @ inv))
    assert got["x"] == pytest.approx((beta[1], beta[1] / se[1]))


def test_bear_dating():
    w = np.array([1.0, 1.1, 1.2, 1.0, 0.9, 0.95, 1.2, 1.3])
    assert dating.bear_states(w).tolist() == [0, 0, 0, 1, 1, 0, 0, 0]
    assert dating.bear_states(np.array([1.0, 1.2, 1.2, 0.9])).tolist() == [0, 0, 1, 1]  # of equal peaks the first counts


def test_a_grid_equals_its_runs_one_by_one(spark):
    rng = np.random.default_rng(4)
    dates = pd.date_range("2001-01-01", periods=90).date
    panel = pd.DataFrame([(f"s{k}", t, float(rng.normal()), float(rng.normal()), float(rng.normal())) for k in range(8) for t in dates], columns=["series_id", "ts", "ret", "a", "b"])
    eff = pd.DataFrame({"ts": dates, "eff": [None if k % 11 == 0 else float(x) for k, x in enumerate(rng.random(90))]})
    p, e = spark.createDataFrame(panel), spark.createDataFrame(eff, "ts date, eff double")
    runs = backtest.grid({4: "a", 8: "b"}, p, e, [5, 7], [0.3, 0.6], train=20, enough=10, arms=(True, False)).toPandas()
    assert len(runs) == 16 * 70
    for mom, refit, share, arm in [(4, 5, 0.3, True), (8, 7, 0.6, True), (8, 5, 0.6, False)]:
        one = backtest.walk_forward(p, e, {4: "a", 8: "b"}[mom], 20, refit, share, enough=10, conditional=arm).toPandas().sort_values("day").reset_index(drop=True)
        own = runs[(runs.mom == mom) & (runs.refit == refit) & (runs.share == share) & (runs.conditional == arm)].sort_values("day").reset_index(drop=True)
        for c in ("day", "fold", "gross", "turnover", "deployed"):
            assert np.allclose(own[c].astype(float), one[c].astype(float), equal_nan=True), c


def test_out_of_sample_scores_by_number_of_states(spark):
    rng = np.random.default_rng(5)
    rows = [("s", d, float(rng.normal() * (0.5 if k // 40 % 2 else 2.0))) for k, d in enumerate(pd.date_range("2001-01-01", periods=400).date)]
    df = spark.createDataFrame(rows, "series_id string, ts date, ret double").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    fits = hmm.fitted(df.where("k = 1").drop("k"), states=(1, 2), restarts=3, most=40)
    got = {r.k: r.m for r in hmm.labelled(df, fits, by=("series_id", "k")).groupBy("k").agg(F.avg("log_score").alias("m")).collect()}
    x = np.array([r[2] for r in rows])
    assert got[1] == pytest.approx(float(np.mean(-0.5 * ((x - x.mean()) / x.std()) ** 2 - np.log(x.std() * np.sqrt(2 * np.pi)))), abs=1e-9)
    assert got[2] > got[1]


def test_regimes_are_recovered(spark):
    scale = np.repeat([0.01, 0.05, 0.01, 0.05], 150)
    x = np.tile([1, -1, 0.5, -1.5, 1.2, -0.3], 100) * scale
    df = panel(spark, {"a": x})
    truth = (scale > 0.02).astype(int)
    fits = hmm.fitted(df, restarts=3)
    label = np.array(values(hmm.labelled(df, fits, smooth=True), "label"))
    assert (label == truth).mean() > 0.97
    filtered, in_parts = values(hmm.labelled(df, fits), "p_high"), values(hmm.block_filter(df, fits, size=37), "p_high")
    assert in_parts == pytest.approx(filtered, abs=1e-9)
    j = jump.labelled(jump.features(df), (30.0,))
    assert (np.array(values(j, "ex_post")) == truth).mean() > 0.9
    cuts = segments.clustered(segments.segmented(df)).orderBy("start").collect()
    assert [r.label for r in cuts] == [0, 1, 0, 1]
    assert all(abs((r.start - DAY).days - t) <= 6 for r, t in zip(cuts, (0, 150, 300, 450)))


def test_cheapest_segmentation_equals_an_unpruned_search():
    rng = np.random.default_rng(1)
    for k in range(60):
        n = int(rng.integers(1, 260))
        x = rng.standard_normal(n) * np.repeat(rng.uniform(0.3, 3, n // 40 + 1), 40)[:n] if k % 5 else np.round(rng.standard_normal(n)) * (rng.random(n) < 0.2)
        for grid, least in ((5, 21), (1, 4), (3, 7)):
            at = np.arange(0, n, grid)
            cells = np.diff(np.append(at, n)).astype(float), np.add.reduceat(x, at), np.add.reduceat(x * x, at)
            penalty = rng.uniform(0.2, 3) * np.log(max(n, 2))
            starts, cost = segments.cheapest(*cells, penalty, least)
            assert (starts, cost) == segments.cheapest(*cells, penalty, least, pruned=False)
            parts = [x[a * grid : b * grid] for a, b in zip(starts, [*starts[1:], n])]
            assert cost == pytest.approx(sum(len(p) * np.log(p.var() + 1e-6) + penalty for p in parts), abs=1e-6)
            assert len(parts) == 1 or min(map(len, parts)) >= least


def test_optimal_segments_cost_no_more_than_greedy_ones(spark):
    scale = np.concatenate([np.repeat([0.01, 0.05, 0.01, 0.05], 150), np.repeat([0.02, 0.03, 0.025, 0.015, 0.05, 0.01], 70)])
    df = panel(spark, {"a": noise(len(scale)) * scale, "b": noise(len(scale)) * 0.01, "short": noise(30), "one": [0.5]})
    found = segments.optimal(df, grid=1)
    assert found.count() == 2 * len(scale) + 31
    best = {r.series_id: r.cost for r in found.select("series_id", "cost").distinct().collect()}
    assert best == pytest.approx({r.series_id: r.cost for r in segments.cost(found).collect()}, abs=1e-6)
    greedy = {r.series_id: r.cost for r in segments.cost(segments.segmented(df)).collect()}
    assert set(best) == set(greedy) and all(best[s] <= greedy[s] + 1e-6 for s in best)
    assert best["a"] < greedy["a"]
    cuts = segments.clustered(segments.optimal(df.where("series_id = 'a'"))).orderBy("start").collect()
    assert [r.segment for r in cuts] == list(range(len(cuts))) and sum(r.n for r in cuts) == len(scale)
    assert segments.optimal(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [7, 64, 5000])
def test_jump_labels_by_blocks_are_those_of_whole_series(spark, size):
    rng = np.random.default_rng(4)
    series = {"a": noise(150) * np.repeat([0.5, 2.0, 0.7], 50), "b": rng.standard_normal(64), "c": [0.1]}
    df = panel(spark, series)
    whole, feats = jump.features(df, n_fit=100).toPandas(), jump.block_features(df, n_fit=100, size=size)
    parts = feats.toPandas()
    for p in (whole, parts):
        p.sort_values(["series_id", "ts"], inplace=True)
    assert np.allclose(whole[jump.FEATURES], parts[jump.FEATURES], atol=1e-9) and len(whole) == 215
    centres = np.round(rng.standard_normal((3, 9)), 2)
    given = [(s, p, centres.ravel().tolist()) for s in series for p in (0.5, 6.0)]
    got = jump.block_labelled(feats, spark.createDataFrame(given, "series_id string, penalty double, centres array<double>"), size).toPandas().sort_values(["series_id", "penalty", "ts"])
    for s, penalty, _ in given:
        x = whole[whole.series_id == s][jump.FEATURES].to_numpy()
        loss = 0.5 * ((x[:, None, :] - centres[None]) ** 2).sum(-1)
        own = got[(got.series_id == s) & (got.penalty == penalty)]
        assert own.ex_post.tolist() == jump.path(loss, penalty)[0].tolist() and own.real_time.tolist() == jump.online(loss, penalty).tolist()


@pytest.mark.parametrize("size", [5, 64, 5000])
def test_expanding_quantiles_by_blocks_are_those_of_all_earlier_rows(spark, size):
    rng = np.random.default_rng(size)
    series = {"a": np.round(rng.standard_normal(150), 1), "trend": np.arange(130.0) + rng.standard_normal(130), "fall": -np.arange(90.0), "same": [2.0] * 40, "one": [1.0], "gaps": [None, 1.0, None, 3.0, 2.0, None, 2.5] * 9}
    df = panel(spark, series).select("series_id", "ts", "ret")
    got = blocks.earlier_quantiles(df, "ret", {"low": 0.33, "high": 0.9}, size=size).toPandas().sort_values(["series_id", "ts"])
    for s, x in series.items():
        own, seen = got[got.series_id == s], []
        assert len(own) == len(x)
        for v, r in zip(x, own.itertuples()):
            if v is None:
                assert r.earlier is None or np.isnan(r.earlier)
                continue
            assert r.earlier == len(seen)
            assert (np.isnan(r.low), np.isnan(r.high)) == (True, True) if not seen else (r.low, r.high) == pytest.approx(np.quantile(seen, [0.33, 0.9]).tolist(), abs=1e-9)
            seen.append(v)
    states = rolling.tercile_states(df, "ret", 20, size).withColumn("want", rolling.tercile_state("ret", 20))
    assert states.where("NOT (state <=> want)").count() == 0 and states.count() == df.count()


@pytest.mark.parametrize("form", ["parquet", "csv", "json"])
def test_tables_are_written_and_read_again(spark, tmp_path, form):
    df = panel(spark, {"a": [0.5, None, -1.25], "b": []})
    for _ in range(2):  # a second one replaces the first
        write_table(df, f"{tmp_path}/{form}", form)
    reader = spark.read.schema(df.schema)
    back = reader.csv(f"{tmp_path}/{form}", header=True) if form == "csv" else reader.format(form).load(f"{tmp_path}/{form}")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_fits_tell_whether_they_converged():
    x = noise(200) * np.repeat([0.5, 2.0], 100)
    assert not hmm.fit(x, 2, restarts=2, most=2)["converged"]
    assert hmm.fit(x, 2, restarts=2, most=300)["converged"]


def test_auc_bootstrap_equals_direct_ranks(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 60)
    s = np.round(rng.standard_normal(60) + y, 1)
    df = spark.createDataFrame([("a", DAY + dt.timedelta(days=i), float(s[i]), int(y[i])) for i in range(60)], "g string, ts date, s double, y int")
    direct = lambda a, b: np.mean([(p > q) + (p == q) / 2 for p in a[b == 1] for q in a[b == 0]])
    rows, drawn = inf._drawn(df, ["g"], 40, 7, True, 7, 50)
    reps = drawn.toPandas().groupby("rep")["_i"].apply(lambda i: direct(s[i.to_numpy()], y[i.to_numpy()]))
    got = inf.auc_bootstrap(df, "s", "y", ["g"], 40, 7).first()
    assert got.value == pytest.approx(direct(s, y))
    assert (got.low, got.high) == pytest.approx((np.percentile(reps, 2.5), np.percentile(reps, 97.5)))


def test_fits_by_blocks_are_those_of_whole_series(spark):
    x = noise(150) * np.repeat([0.5, 2.0, 0.7], 50)
    want = hmm.fit(x, 2, restarts=1, most=4, tolerance=-np.inf)
    got = hmm.block_fitted(panel(spark, {"a": x}), rounds=4, size=40).first()
    assert got.mu == pytest.approx(want["mu"].tolist(), abs=1e-8) and got.sd == pytest.approx(want["sd"].tolist(), abs=1e-8)
    assert got.a == pytest.approx(want["a"].tolist(), abs=1e-6) and got.pi == pytest.approx(want["pi"].tolist(), abs=1e-8)


def simulated(n, omega, alpha, beta, nu, seed):
    rng = np.random.default_rng(seed)
    h, x = omega / (1 - alpha - beta), []
    for _ in range(n):
        v = math.sqrt(h) * (rng.standard_t(nu) * math.sqrt((nu - 2) / nu) if nu else rng.standard_normal())
        x.append(0.03 + v)
        h = omega + alpha * v * v + beta * h
    return np.array(x)


def direct_garch(x, student):
    """The highest likelihood that a simplex search from several starts finds, by the recursion row by row."""

    def value(p):
        mean, omega, alpha, beta, nu = p
        if omega <= 0 or alpha < 0 or beta < 0 or alpha + beta >= 1 or not 2.01 < nu < 500:
            return -math.inf
        e2 = (x - mean) ** 2
        return float(garch.loglik(e2, garch.variances(e2, x.var(), np.array([alpha]), np.array([beta]), np.array([omega])), nu if student else None)[0])

    best = -math.inf
    for alpha, beta in ((0.1, 0.8), (0.2, 0.4)):
        start = np.array([x.mean(), x.var() * (1 - alpha - beta), alpha, beta, 7.0])
        simplex = [start, *(start + np.diag(np.array([0.1 * x.std(), 0.5 * start[1], 0.05, -0.1, 3.0]))[k] for k in range(5 if student else 4))]
        pairs = sorted(((value(p), k, p) for k, p in enumerate(simplex)), reverse=True)
        for k in range(400):
            worst, middle = pairs[-1], np.mean([q[2] for q in pairs[:-1]], axis=0)
            tried = [(value(p), 10 + k, p) for p in (middle + w * (middle - worst[2]) for w in (1.0, 2.0, 0.5, -0.5))]
            top = max(tried, key=lambda q: q[0])
            if top[0] > worst[0]:
                pairs[-1] = top
            else:
                pairs = [pairs[0], *((value(p), q[1], p) for q in pairs[1:] for p in [(q[2] + pairs[0][2]) / 2])]
            pairs.sort(key=lambda q: (q[0], q[1]), reverse=True)
        best = max(best, pairs[0][0])
    return best


def test_garch_by_likelihood(spark):
    series = {"a": simulated(400, 0.05, 0.15, 0.8, 0, 1), "b": simulated(300, 0.2, 0.3, 0.5, 5, 2), "c": simulated(120, 1.0, 0.0, 0.0, 0, 3)}
    df = panel(spark, {**series, "short": noise(30), "flat": [1.0] * 60})
    found = {(r.series_id, r.law): r for r in garch.by_law(df).collect()}
    assert set(found) == {(s, law) for s in series for law in ("normal", "student")} and all(r.converged for r in found.values())
    for (s, law), r in found.items():
        e2 = (series[s] - r["mean"]) ** 2
        h = garch.variances(e2, r.target, np.array([r.alpha]), np.array([r.beta]), np.array([r.omega]))
        assert r.loglik == pytest.approx(float(garch.loglik(e2, h, r.nu or None)[0]), abs=1e-8)
        assert r.loglik >= direct_garch(series[s], law == "student") - 1e-4
    for nus, law in (((0.0,), "normal"), ((4.0, 8.0, 12.0), "student")):
        for r in garch.gridded(df, nus=nus).collect():
            assert found[r.series_id, law].loglik >= r.loglik
    chosen = {r.series_id: r for r in garch.fitted(df).collect()}
    assert chosen["a"].law == "normal" and chosen["b"].law == "student" and 0.05 < chosen["a"].alpha < 0.4 and 0.4 < chosen["a"].beta < 0.95
    z = garch.residuals(df, garch.fitted(df)).groupBy("series_id").agg(F.stddev("z").alias("z")).collect()
    assert [r.z for r in z] == pytest.approx([1] * 3, abs=0.1)


def test_fits_by_blocks_settle_one_by_one(spark):
    series = {"a": noise(150) * np.repeat([0.5, 2.0, 0.7], 50), "b": noise(97) * np.repeat([1.0, 3.0], [60, 37])}
    got = {(r.series_id, r.k): r for r in hmm.block_fitted(panel(spark, series), states=(1, 2), restarts=2, tolerance=1e-4, size=40).collect()}
    assert set(got) == {(s, k) for s in series for k in (1, 2)}
    for (s, k), r in got.items():
        want = hmm.fit(np.asarray(series[s]), k, restarts=2, tolerance=1e-4)
        assert r.converged and want["converged"] and r.loglik == pytest.approx(want["loglik"], abs=1e-6) and r.bic == pytest.approx(want["bic"], abs=1e-6)
        assert r.sd == pytest.approx(want["sd"].tolist(), abs=1e-6) and r.a == pytest.approx(want["a"].tolist(), abs=1e-6)


def test_garch_by_rounds_over_blocks_is_that_of_whole_series(spark):
    df = panel(spark, {"a": simulated(241, 0.05, 0.15, 0.8, 0, 1), "b": simulated(200, 0.2, 0.3, 0.5, 5, 2), "short": simulated(60, 0.2, 0.3, 0.5, 5, 3)})
    whole = {(r.series_id, r.law): r for r in garch.by_law(df).collect()}
    for size in (80, 240):
        parts = {(r.series_id, r.law): r for r in garch.by_law(df, size=size).collect()}
        assert set(parts) == set(whole)
        for k, r in whole.items():
            assert parts[k].loglik == pytest.approx(r.loglik, abs=1e-6) and parts[k].n == r.n
            assert (parts[k].alpha, parts[k].beta, parts[k].omega) == pytest.approx((r.alpha, r.beta, r.omega), abs=2e-3)


def test_deflated_sharpe_counts_its_trials(spark):
    rng = np.random.default_rng(9)
    trials = {k: rng.standard_normal(200) * 0.01 + 0.0005 * k for k in range(6)}
    df = spark.createDataFrame([(k, float(x)) for k, v in trials.items() for x in v], "trial int, pnl double")
    got = inf.deflated_sharpe(df, "pnl", ["trial"])
    sr = {k: v.mean() / v.std(ddof=1) for k, v in trials.items()}
    best = max(sr, key=sr.get)
    v = trials[best]
    z = (v - v.mean()) / v.std()
    skew, kurtosis = (z**3).mean(), (z**4).mean()
    benchmark = inf.expected_max_sharpe(float(np.var(list(sr.values()), ddof=1)), 6)
    want = distributions.normal_cdf((sr[best] - benchmark) * math.sqrt(199) / math.sqrt(1 - skew * sr[best] + (kurtosis - 1) / 4 * sr[best] ** 2))
    assert got["best"] == {"trial": best} and got["trials"] == 6
    assert got["benchmark"] == pytest.approx(benchmark) and got["dsr"] == pytest.approx(want)
    assert inf.deflated_sharpe(df.limit(0), "pnl", ["trial"])["dsr"] is None


def test_auc_interval_is_of_replicates_drawn_by_blocks(spark):
    rng = np.random.default_rng(10)
    y = (rng.random(120) < 0.4).astype(int)
    x = np.round(y * 0.8 + rng.standard_normal(120), 2)
    df = spark.createDataFrame([("s", DAY + dt.timedelta(days=i), float(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "series_id string, ts date, x double, y int")
    got = inf.auc_bootstrap(df, "x", "y", ["series_id"], 60, 10).first()
    rows, drawn = inf._drawn(df, ["series_id"], 60, 10, True, 7, 50)
    reps = drawn.join(rows, ["series_id", "_i"]).select("rep", "x", "y").toPandas()

    def auc(p):
        a, b = p.x[p.y == 1].to_numpy(), p.x[p.y == 0].to_numpy()
        return ((a[:, None] > b) + 0.5 * (a[:, None] == b)).mean()

    values = [auc(p) for _, p in reps.groupby("rep")]
    assert len(values) == 60 and all(len(p) == 120 for _, p in reps.groupby("rep"))
    assert got["value"] == pytest.approx(auc(pd.DataFrame({"x": x, "y": y})))
    assert (got["low"], got["high"]) == (pytest.approx(np.quantile(values, 0.025)), pytest.approx(np.quantile(values, 0.975)))
