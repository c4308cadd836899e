"""Queries of regime models, learned signals and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.operators import aggregates as A
from driftwell.operators import behavior as B
from driftwell.operators import inference as I
from driftwell.operators import learned, rolling
from driftwell.operators.cleaning import in_time
from driftwell.operators.regimes import garch, hmm, jump, segments
from driftwell.plans import fixtures as S
from driftwell.plans.panel_queries import last_dates, r, rounded
from driftwell.sources import panel as P
from driftwell.streaming import run, signals

QUERIES: dict = {}
SQL: dict[str, str] = {}
DATES: dict[str, tuple[str, ...]] = {}


def query(sql: str | None = None, dates: tuple[str, ...] | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
            DATES[f.__name__] = dates if dates is not None else last_dates(sql)
        return f

    return add


def weekly(spark, d) -> DataFrame:
    return P.brand_week(spark, d).select("series_id", "ts", "ret").where("ret is not null")


@query()
def hmm_fit(spark, d):
    """One to four states of each brand, and the number of states of least BIC."""
    fits = hmm.fitted(weekly(spark, d), states=(1, 2, 3, 4), restarts=5, most=300)
    best = A.best(fits, ["series_id"], "bic", ["k"], largest=False).select("series_id", F.col("k").alias("best_k"))
    return rounded(fits.join(best, "series_id").select("series_id", "k", "best_k", "loglik", "bic", "n", "converged", F.get("sd", F.lit(0)).alias("sd_low"), F.element_at("sd", -1).alias("sd_high")))


@query()
def hmm_block_fit(spark, d):
    """Five rounds of the fit on blocks of 128 rows, as for series of any length."""
    fits = hmm.block_fitted(weekly(spark, d), states=(1, 2), rounds=5, size=128)
    return rounded(fits.select("series_id", "k", "loglik", "n", F.get("sd", F.lit(0)).alias("sd_low"), F.element_at("sd", -1).alias("sd_high")))


@query()
def hmm_smooth(spark, d):
    """Ex-post labels of two states."""
    df = weekly(spark, d)
    return rounded(hmm.labelled(df, hmm.fitted(df, restarts=3, most=40), smooth=True).select("series_id", "ts", "p_high", "label"))


@query()
def hmm_parameters(spark, d):
    return rounded(hmm.parameter_table(hmm.fitted(weekly(spark, d), restarts=3, most=40), 52))


#: Given parameters: a calm and a wild state of each series, from its own deviation.
_PI, _STAY = 0.5, 0.95


def _given(df: DataFrame) -> DataFrame:
    g = df.groupBy("series_id").agg(F.avg("ret").alias("m"), F.stddev_pop("ret").alias("s"))
    arr = lambda *x: F.array(*(F.lit(v) if isinstance(v, float) else v for v in x))
    return g.select("series_id", F.lit(2).alias("k"), arr(_PI, 1 - _PI).alias("pi"), arr(_STAY, 1 - _STAY, 1 - _STAY, _STAY).alias("a"), arr(F.col("m"), F.col("m")).alias("mu"), arr(F.col("s") * 0.5, F.col("s") * 1.5).alias("sd"))


@query(
    f"""WITH RECURSIVE {S.BRAND_WEEK}, v AS (SELECT series_id, ts, ret, row_number() OVER ({S.W}) AS rn, avg(ret) OVER (PARTITION BY series_id) AS m, stddev_pop(ret) OVER (PARTITION BY series_id) AS s FROM panel WHERE ret IS NOT NULL),
    d AS (SELECT *, exp(-0.5 * ((ret - m) / (0.5 * s)) ** 2) / (0.5 * s * sqrt(2 * pi())) AS b0, exp(-0.5 * ((ret - m) / (1.5 * s)) ** 2) / (1.5 * s * sqrt(2 * pi())) AS b1 FROM v),
    f AS (SELECT series_id, ts, rn, 0.5 * b1 / (0.5 * b0 + 0.5 * b1) AS p, ln(0.5 * b0 + 0.5 * b1) AS ls FROM d WHERE rn = 1
        UNION ALL SELECT d.series_id, d.ts, d.rn, (0.05 + 0.9 * f.p) * b1 / ((0.95 - 0.9 * f.p) * b0 + (0.05 + 0.9 * f.p) * b1), ln((0.95 - 0.9 * f.p) * b0 + (0.05 + 0.9 * f.p) * b1) FROM d JOIN f ON d.series_id = f.series_id AND d.rn = f.rn + 1)
    SELECT series_id, ts, {r('p', 'p_high')}, {r('ls', 'log_score')} FROM f"""
)
def hmm_filter(spark, d):
    """On blocks of 64 rows, as for series of any length."""
    df = weekly(spark, d)
    return rounded(hmm.block_filter(df, _given(df), size=64))


@query()
def hmm_yearly(spark, d):
    """Real-time labels: each year by a model of the years before it."""
    return rounded(hmm.yearly(weekly(spark, d), first=52))


@query()
def parameter_stability(spark, d):
    """Deviations of the two states fitted on either half of each series, and agreement of the second half's labels under both."""
    df = weekly(spark, d).withColumn("half", F.ntile(2).over(in_time()))
    fits = hmm.fitted(df, by=("series_id", "half"), restarts=3, most=40)
    second = df.where("half = 2")
    own = hmm.labelled(second, fits.where("half = 2").drop("half")).select("series_id", "ts", F.col("label").alias("own"))
    old = hmm.labelled(second, fits.where("half = 1").drop("half")).select("series_id", "ts", F.col("label").alias("old"))
    k = I.kappa(own.join(old, ["series_id", "ts"]), "own", "old", ["series_id"])
    sds = fits.groupBy("series_id").agg(*(F.max(F.when(F.col("half") == h, F.element_at("sd", i))).alias(f"sd_{n}_{h}") for h in (1, 2) for i, n in ((1, "low"), (-1, "high"))))
    return rounded(k.join(sds, "series_id"))


@query()
def oos_log_score(spark, d):
    """Mean log predictive density after 2000 of models of one to three states fitted before."""
    df = weekly(spark, d)
    cut = F.lit("2000-01-01").cast("date")
    fits = hmm.fitted(df.where(F.col("ts") < cut), states=(1, 2, 3), restarts=2, most=30)
    rows = df.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    scores = hmm.labelled(rows, fits, by=("series_id", "k"))
    return rounded(scores.where(F.col("ts") >= cut).groupBy("series_id", "k").agg(F.avg("log_score").alias("log_score"), F.count("*").alias("n")))


@query(
    f"""WITH {S.BRAND_WEEK}, x AS (SELECT series_id, ts, ret FROM panel WHERE ret IS NOT NULL), m AS (SELECT series_id, avg(ret) AS m, stddev_pop(ret) AS s FROM x WHERE ts < DATE '2000-01-01' GROUP BY 1 HAVING count(*) >= 30)
    SELECT series_id, {r('avg(-0.5 * ((ret - m) / s) ** 2 - ln(s * sqrt(2 * pi())))', 'log_score')}, count(*) AS n FROM x JOIN m USING (series_id) WHERE ts >= DATE '2000-01-01' GROUP BY 1""",
    dates=(),
)
def oos_log_score_one(spark, d):
    """The same of the model of one state, which SQL can say."""
    df, cut = weekly(spark, d), F.lit("2000-01-01").cast("date")
    scores = hmm.labelled(df, hmm.fitted(df.where(F.col("ts") < cut), states=(1,), restarts=1, most=5))
    return rounded(scores.where(F.col("ts") >= cut).groupBy("series_id").agg(F.avg("log_score").alias("log_score"), F.count("*").alias("n")))


@query()
def jump_fit(spark, d):
    """Jump-model labels of each brand and penalty: share, switches, and agreement of online with fitted ones."""
    labels = jump.labelled(jump.features(weekly(spark, d)))
    k = I.kappa(labels, "ex_post", "real_time", ["series_id", "penalty"])
    share = labels.groupBy("series_id", "penalty").agg(F.avg("ex_post").alias("share"), F.max("objective").alias("objective"))
    return rounded(k.join(share, ["series_id", "penalty"]))


@query()
def jump_online(spark, d):
    return rounded(jump.labelled(jump.features(weekly(spark, d)), (30.0,), 0.5).select("series_id", "ts", "real_time"))


_HALVES = (5, 10, 21)
_WEIGHT = {h: f"0.5 ** ((a.rn - b.rn) / {h}.0)" for h in _HALVES}
_FEATURES = {f"{kind}{h}": sql.format(h=h) for h in _HALVES for kind, sql in (("mean", "m{h}"), ("down", "ln(d{h})"), ("sortino", "m{h} / d{h}"))}


_SCALED = f"""{S.BRAND_WEEK}, v AS (SELECT series_id, ts, ret AS x, row_number() OVER ({S.W}) AS rn FROM panel WHERE ret IS NOT NULL),
    e AS (SELECT a.series_id, a.ts, a.rn, {', '.join(f"sum(b.x * {w}) / sum({w}) AS m{h}, greatest(sqrt(sum(least(b.x, 0) ** 2 * {w}) / sum({w})), 1e-8) AS d{h}" for h, w in _WEIGHT.items())} FROM v a JOIN v b ON a.series_id = b.series_id AND b.rn <= a.rn GROUP BY 1, 2, 3),
    f AS (SELECT series_id, ts, rn, {', '.join(f'{sql} AS {name}' for name, sql in _FEATURES.items())} FROM e), s AS (SELECT series_id, {', '.join(f'avg({n}) AS a_{n}, stddev_pop({n}) AS s_{n}' for n in _FEATURES)} FROM f WHERE rn <= 200 GROUP BY 1),
    z AS MATERIALIZED (SELECT series_id, ts, rn, {', '.join(f'greatest(-5, least(5, ({n} - a_{n}) / CASE WHEN s_{n} > 1e-12 THEN s_{n} ELSE 1 END)) AS {n}' for n in _FEATURES)} FROM f JOIN s USING (series_id))"""


@query(f"WITH {_SCALED} SELECT series_id, ts, {', '.join(r(n, n) for n in _FEATURES)} FROM z")
def jump_features(spark, d):
    """On blocks of 64 rows, as for series of any length."""
    return rounded(jump.block_features(weekly(spark, d), n_fit=200, size=64))


#: A calm and a wild state: good means and little downside, and the other way round.
_CALM = {n: {"mean": 0.3, "down": -0.5, "sortino": 0.3}[n.rstrip("0123456789")] for n in _FEATURES}
_COST = {k: " + ".join(f"0.5 * ({n} - {sign * c}) ** 2" for n, c in _CALM.items()) for k, sign in ((0, 1), (1, -1))}


@query(
    f"""WITH RECURSIVE {_SCALED}, l AS MATERIALIZED (SELECT series_id, ts, rn, {_COST[0]} AS l0, {_COST[1]} AS l1 FROM z),
    fw AS (SELECT series_id, ts, rn, l0 AS v0, l1 AS v1, 0 AS b0, 1 AS b1 FROM l WHERE rn = 1
        UNION ALL SELECT l.series_id, l.ts, l.rn, least(v0, v1 + 5) + l0, least(v1, v0 + 5) + l1, CASE WHEN v0 <= least(v0, v1) + 5 THEN 0 ELSE 1 END, CASE WHEN v1 <= least(v0, v1) + 5 THEN 1 ELSE 0 END
        FROM fw JOIN l ON l.series_id = fw.series_id AND l.rn = fw.rn + 1),
    bw AS (SELECT series_id, rn, CASE WHEN v0 <= v1 THEN 0 ELSE 1 END AS now FROM fw WHERE (series_id, rn) IN (SELECT (series_id, max(rn)) FROM fw GROUP BY series_id)
        UNION ALL SELECT fw.series_id, fw.rn - 1, CASE WHEN bw.now = 0 THEN b0 ELSE b1 END FROM bw JOIN fw ON fw.series_id = bw.series_id AND fw.rn = bw.rn WHERE fw.rn > 1)
    SELECT series_id, ts, CAST(now AS INT) AS ex_post, CASE WHEN v0 <= v1 THEN 0 ELSE 1 END AS real_time FROM fw JOIN bw USING (series_id, rn)"""
)
def jump_labels(spark, d):
    """Labels of two given states at a penalty of 5, on blocks of 64 rows."""
    feats = jump.block_features(weekly(spark, d), n_fit=200, size=64)
    centres = F.array(*(F.lit(sign * c) for sign in (1, -1) for c in (_CALM[n] for n in jump.FEATURES)))
    given = feats.select("series_id").distinct().select("series_id", F.lit(5.0).alias("penalty"), centres.alias("centres"))
    return jump.block_labelled(feats, given, size=64).select("series_id", "ts", "ex_post", "real_time")


#: The cheapest segmentation by dynamic programming over every earlier beginning: lists hold the best cost up to each cell and where its last segment begins.
_SEGMENTED = f"""{S.TYPE_DAY}, v AS (SELECT series_id, ts, ret AS x, row_number() OVER ({S.W}) - 1 AS rn, ret - avg(ret) OVER (PARTITION BY series_id) AS y FROM panel WHERE ret IS NOT NULL),
    cells AS (SELECT series_id, rn // 5 AS cell, count(*) AS n, sum(y) AS s1, sum(y * y) AS s2 FROM v GROUP BY 1, 2),
    upto AS (SELECT series_id, cell, sum(n) OVER (PARTITION BY series_id ORDER BY cell) AS n, sum(s1) OVER (PARTITION BY series_id ORDER BY cell) AS s1, sum(s2) OVER (PARTITION BY series_id ORDER BY cell) AS s2 FROM cells),
    sums AS MATERIALIZED (SELECT series_id, list_prepend(0, list(n ORDER BY cell)) AS n, list_prepend(0, list(s1 ORDER BY cell)) AS s1, list_prepend(0, list(s2 ORDER BY cell)) AS s2, 3 * ln(max(n)) AS pen FROM upto GROUP BY 1),
    search AS (SELECT series_id, 0 AS j, [0.0::DOUBLE] AS best, 0 AS start FROM sums
        UNION ALL SELECT series_id, j + 1, list_append(best, got.v + pen), got.s FROM (SELECT series_id, j, best, pen,
            list_min(list_transform(list_filter(range(0, j + 1), lambda i: best[i + 1] IS NOT NULL AND (n[j + 2] - n[i + 1] >= 21 OR i = 0 AND n[len(n)] < 42 AND j + 2 = len(n))), lambda i: {{'v': best[i + 1] + (n[j + 2] - n[i + 1])
                * ln(greatest((s2[j + 2] - s2[i + 1]) / (n[j + 2] - n[i + 1]) - ((s1[j + 2] - s1[i + 1]) / (n[j + 2] - n[i + 1])) ** 2, 0) + 1e-6), 's': i}})) AS got
            FROM search JOIN sums USING (series_id) WHERE j + 1 < len(n))),
    walk AS (SELECT series_id, j AS stop, start FROM search WHERE (series_id, j) IN (SELECT (series_id, max(j)) FROM search GROUP BY series_id)
        UNION ALL SELECT s.series_id, s.j, s.start FROM walk w JOIN search s ON s.series_id = w.series_id AND s.j = w.start WHERE w.start > 0),
    segs AS (SELECT series_id, start, stop, row_number() OVER (PARTITION BY series_id ORDER BY start) - 1 AS segment FROM walk)"""


@query(
    f"""WITH RECURSIVE {_SEGMENTED}, g AS (SELECT v.series_id, segment, min(ts) AS start, max(ts) AS stop, count(*) AS n, stddev_pop(x) AS sd, ln(greatest(stddev_pop(x), 1e-12)) AS l FROM v JOIN segs s ON v.series_id = s.series_id AND rn // 5 >= s.start AND rn // 5 < s.stop GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY series_id) AS m, sum(l) OVER w AS a, sum(l) OVER (PARTITION BY series_id) AS t FROM g WINDOW w AS (PARTITION BY series_id ORDER BY l, segment)),
    c AS (SELECT series_id, i AS cut FROM o WHERE i < m QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY a * a / i + (t - a) * (t - a) / (m - i) DESC, i) = 1)
    SELECT o.series_id, segment, start, stop, n, {r('sd', 'sd')}, coalesce(CAST(i > cut AS INT), 0) AS label FROM o LEFT JOIN c USING (series_id)""",
    dates=("start", "stop"),
)
def changepoints(spark, d):
    """The cheapest of all segmentations of each daily series, and its segments in two clusters of deviation."""
    return rounded(segments.clustered(segments.optimal(P.type_day(spark, d))))


@query()
def changepoints_greedy(spark, d):
    """Binary splits instead, each the best of its segment: what they cost beside the cheapest segmentation at the same boundaries and penalty."""
    df = P.type_day(spark, d)
    best = segments.optimal(df, grid=1).groupBy("series_id").agg(F.countDistinct("segment").alias("segments"), F.max("cost").alias("cost"))
    greedy = segments.cost(segments.segmented(df)).select("series_id", F.col("segments").alias("greedy_segments"), F.col("cost").alias("greedy_cost"))
    return rounded(best.join(greedy, "series_id"), "cost", "greedy_cost")


@query()
def garch_fit(spark, d):
    """The most likely parameters of each brand under normal and Student errors."""
    return rounded(garch.by_law(weekly(spark, d)))


@query()
def garch_pit(spark, d):
    df = weekly(spark, d)
    return rounded(garch.residuals(df, garch.fitted(df)))


@query(
    f"""WITH RECURSIVE {S.BRAND_WEEK}, v AS (SELECT series_id, ts, ret - avg(ret) OVER (PARTITION BY series_id) AS e, var_pop(ret) OVER (PARTITION BY series_id) AS t, row_number() OVER ({S.W}) AS rn FROM panel WHERE ret IS NOT NULL),
    h AS (SELECT series_id, ts, rn, e, t, t AS h FROM v WHERE rn = 1 UNION ALL SELECT v.series_id, v.ts, v.rn, v.e, v.t, 0.05 * v.t + 0.1 * h.e * h.e + 0.85 * h.h FROM v JOIN h ON v.series_id = h.series_id AND v.rn = h.rn + 1)
    SELECT series_id, ts, {r('h', 'variance')}, {r('e / sqrt(h)', 'z')} FROM h"""
)
def garch_filter(spark, d):
    """Variances under alpha 0.1, beta 0.85 and each series' own mean and variance."""
    df = weekly(spark, d)
    given = df.groupBy("series_id").agg(F.avg("ret").alias("mean"), F.var_pop("ret").alias("target")).withColumns({"alpha": F.lit(0.1), "beta": F.lit(0.85), "omega": 0.05 * F.col("target"), "nu": F.lit(0.0)})
    return rounded(garch.residuals(df, given).select("series_id", "ts", "variance", "z"))


@query()
def regimes_by_bic(spark, d):
    """The number of states of least BIC on raw and on GARCH-filtered returns."""
    df = weekly(spark, d)
    pit = garch.residuals(df, garch.fitted(df)).select("series_id", "ts", F.col("pit").alias("ret"))
    both = df.withColumn("series", F.lit("raw")).unionByName(pit.withColumn("series", F.lit("pit")))
    fits = hmm.fitted(both, by=("series_id", "series"), states=(1, 2, 3, 4), restarts=3, most=300)
    best = A.best(fits, ["series_id", "series"], "bic", ["k"], largest=False)
    return A.crosstab(best, "series", "k", [1, 2, 3, 4])


def _features(spark, d) -> DataFrame:
    df = B.asset_signal(P.brand_week(spark, d), least=26).withColumn("vol", rolling.rolling_std("ret", 20, 10))
    ahead = F.lead("ret", 1).over(in_time())
    return df.select("series_id", "ts", "z_mom", "z_asym", "z_illiq", "vol", F.when(ahead.isNotNull(), (ahead > 0).cast("int")).alias("up"), F.when(F.col("vol").isNotNull(), (F.abs("ret") > F.col("vol")).cast("int")).alias("wild"))


@query()
def learned_signal(spark, d):
    told = learned.walk_forward(_features(spark, d), ["z_mom", "z_asym", "z_illiq", "vol"], "up", "gbt", train=156, refit=104, embargo=1, rounds=10)
    return rounded(learned.conviction(told))


@query()
def regime_classifier(spark, d):
    return rounded(learned.walk_forward(_features(spark, d), ["z_mom", "z_asym", "z_illiq", "vol"], "wild", "logistic", train=156, refit=104, embargo=1))


@query()
def scorecard(spark, d):
    """Checks of the weekly regimes: agreement of two methods, BIC, and whether calm and wild weeks differ."""
    df = weekly(spark, d)
    fits = hmm.fitted(df, states=(1, 2), restarts=2, most=25)
    two = hmm.labelled(df, fits.where("k = 2")).select("series_id", "ts", F.col("label").alias("hmm"))
    jumps = jump.labelled(jump.features(df), (30.0,)).select("series_id", "ts", F.col("ex_post").alias("jump"))
    kappa = I.kappa(two.join(jumps, ["series_id", "ts"]), "hmm", "jump", ["series_id"]).agg(F.percentile("kappa", F.lit(0.5)).alias("value"))
    best = A.best(fits, ["series_id"], "bic", ["k"], largest=False).agg(F.avg((F.col("k") == 2).cast("double")).alias("value"))
    sd = fits.where("k = 2").agg(F.avg(F.try_divide(F.element_at("sd", -1), F.get("sd", F.lit(0)))).alias("value"))
    rows = [(kappa, "methods", "median kappa", 0.6), (best, "number", "share with two states", 0.5), (sd, "size", "mean deviation ratio", 1.5)]
    out = None
    for df_, group, name, threshold in rows:
        one = df_.select(F.lit(group).alias("kind"), F.lit(name).alias("criterion"), "value", F.lit(threshold).alias("threshold"))
        out = one if out is None else out.unionByName(one)
    verdict = F.when(F.col("value").isNull(), "INCONCLUSIVE").when(F.col("value") >= F.col("threshold"), "PASS").otherwise("FAIL")
    return rounded(out.withColumn("verdict", verdict))


_CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 2 HOUR"


@query(
    f"""SELECT event_type AS series_id, CAST(date_trunc('hour', ts) AS VARCHAR) AS start, CAST(date_trunc('hour', ts) + INTERVAL 1 HOUR AS VARCHAR) AS stop, count(*) AS n, {r('avg(value)', 'mean')}, min(value) AS low, max(value) AS high
    FROM events GROUP BY event_type, date_trunc('hour', ts) HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= {_CLOSED}""",
    dates=(),
)
def stream_bars(spark, d):
    """Hours that the watermark has closed."""
    df = run.available(signals.bars(run.events(spark, d), "event_type", "value"))
    return rounded(df.withColumns({c: F.col(c).cast("timestamp_ntz").cast("string") for c in ("start", "stop")}), "mean")


@query(
    f"""WITH e AS (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * unnest([0, 1, 2, 3])) AS b FROM events)
    SELECT event_type AS series_id, CAST(b AS VARCHAR) AS start, CAST(b + INTERVAL 1 HOUR AS VARCHAR) AS stop, count(*) AS n, {r('avg(value)', 'mean')}, min(value) AS low, max(value) AS high
    FROM e GROUP BY event_type, b HAVING b + INTERVAL 1 HOUR <= {_CLOSED}""",
    dates=(),
)
def stream_sliding_bars(spark, d):
    df = run.available(signals.bars(run.events(spark, d), "event_type", "value", "1 hour", "15 minutes"))
    return rounded(df.withColumns({c: F.col(c).cast("timestamp_ntz").cast("string") for c in ("start", "stop")}), "mean")


@query()
def stream_volatility(spark, d):
    """Rows behind the last watermark wait for later events, and are not in the result."""
    return rounded(run.available(signals.recursion(run.events(spark, d), "event_type", "value", signals.ewma_step(), [0.0, 0.0, 0.0], "ret double, vol double")))


@query()
def stream_hmm(spark, d):
    """States of event values under given parameters; rows behind the last watermark wait for later events."""
    step, start = signals.hmm_step([0.5, 0.5], [[0.95, 0.05], [0.05, 0.95]], [40.0, 60.0], [20.0, 40.0])
    return rounded(run.available(signals.recursion(run.events(spark, d), "event_type", "value", step, start, "p_high double, label int")))


@query()
def stream_jump(spark, d):
    """Rows behind the last watermark wait for later events, and are not in the result."""
    step, start = signals.jump_step([2.0, 4.0], 3.0)
    logs = run.events(spark, d).where("value > 0").withColumn("value", F.log("value"))
    return run.available(signals.recursion(logs, "event_type", "value", step, start, "label int"))
