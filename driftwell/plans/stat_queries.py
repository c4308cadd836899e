"""Queries of label metrics, inference and backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.functions.distributions import two_sided_p, two_sided_t
from driftwell.operators import aggregates as A
from driftwell.operators import backtest as T
from driftwell.operators import cleaning, joins
from driftwell.operators import inference as I
from driftwell.operators import ranks as K
from driftwell.operators import rolling as R
from driftwell.operators.regimes import dating
from driftwell.plans import fixtures as S
from driftwell.plans.panel_queries import last_dates, r, rounded, stressed
from driftwell.sources import panel as P
from driftwell.sources.shared import saved

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


_SCORED = "scored AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality, l.toxic, 1 - l.toxic AS clean, CAST(d.n_chars >= 1500 AS INT) AS long FROM labels l JOIN documents d USING (doc_id))"


def scored(spark, d) -> DataFrame:
    docs = P.table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    df = P.table(spark, d, "labels").join(docs, "doc_id")
    return df.withColumns({"clean": 1 - F.col("toxic"), "long": (F.col("n_chars") >= 1500).cast("int")})


@query(
    f"""WITH {_SCORED}, g AS (SELECT lang, n_chars, sum(quality) AS p, sum(1 - quality) AS q FROM scored GROUP BY 1, 2),
    c AS (SELECT lang, p, q, p * (coalesce(sum(q) OVER (PARTITION BY lang ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS w FROM g)
    SELECT lang, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg, {r('sum(w) / nullif(sum(p) * sum(q), 0)', 'auc')} FROM c GROUP BY 1"""
)
def auc(spark, d):
    return rounded(I.auc(scored(spark, d), "n_chars", "quality", ["lang"]))


@query(
    f"""WITH {_SCORED} SELECT lang, count(*) AS n, {r('avg(CAST(long = quality AS DOUBLE))', 'accuracy')}, {r('greatest(avg(quality), 1 - avg(quality))', 'majority')}, {r('avg(quality) FILTER (long = 1)', 'precision')},
    {r('avg(long) FILTER (quality = 1)', 'recall')}, {r('avg(quality)', 'base_rate')} FROM scored GROUP BY 1"""
)
def classification_metrics(spark, d):
    return rounded(I.classification(scored(spark, d), "long", "quality", ["lang"]))


@query(
    f"""WITH {_SCORED}, m AS (SELECT doc_id, lang, unnest([{{'m': 'clean', 'v': clean}}, {{'m': 'long', 'v': long}}, {{'m': 'quality', 'v': quality}}]) AS x FROM scored),
    p AS (SELECT a.lang, a.x.m AS a, b.x.m AS b, a.x.v AS x, b.x.v AS y FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.x.m < b.x.m),
    g AS (SELECT lang, a, b, count(*) AS n, avg(CAST(x = y AS DOUBLE)) AS agreement, avg(x) * avg(y) + (1 - avg(x)) * (1 - avg(y)) AS e FROM p GROUP BY 1, 2, 3)
    SELECT lang, a, b, n, {r('agreement', 'agreement')}, {r('CASE WHEN 1 - e > 1e-12 THEN (agreement - e) / (1 - e) END', 'kappa')} FROM g"""
)
def kappa_matrix(spark, d):
    df = scored(spark, d)
    labels = df.select(F.col("lang").alias("series_id"), F.col("doc_id").alias("ts"), F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("label")) for m in ("clean", "long", "quality")))).alias("x")).select("series_id", "ts", "x.*")
    return rounded(I.kappa(joins.method_pairs(labels), "label_a", "label_b", ["series_id", "a", "b"]).withColumnRenamed("series_id", "lang"))


@query(f"WITH {_SCORED}, x AS (SELECT lang, quality, avg(CAST(long = quality AS DOUBLE)) AS v FROM scored GROUP BY 1, 2) SELECT lang, count(*) AS classes, {r('avg(v)', 'balanced_accuracy')} FROM x GROUP BY 1")
def balanced_accuracy(spark, d):
    return rounded(I.balanced_accuracy(scored(spark, d), "long", "quality", ["lang"]))


@query()
def bootstrap_auc(spark, d):
    """Bootstrap intervals of each language: labels have no time, ids stand for it. Shares are of drawn rows where they are known."""
    df = scored(spark, d).withColumn("ts", F.col("doc_id"))
    shares = {"accuracy": F.col("long") == F.col("quality"), "base_rate": F.col("quality")}
    for k, c in shares.items():
        df = df.withColumns({f"{k}_sum": F.coalesce(c.cast("double"), F.lit(0.0)), f"{k}_of": c.isNotNull().cast("double")})
    metrics = {k: F.try_divide(F.col(f"mean_{k}_sum"), F.col(f"mean_{k}_of")) for k in shares}
    rest = I.moment_bootstrap(df, [f"{k}_{x}" for k in shares for x in ("sum", "of")], metrics, ["lang"], 500)
    return rounded(I.auc_bootstrap(df, "n_chars", "quality", ["lang"], 500).unionByName(rest))


_LABELLED = f"""{S.BRAND_WEEK}, x AS (SELECT series_id, ts, ret, CAST(volume >= avg(volume) OVER (PARTITION BY series_id) AS INT) AS truth,
    CASE WHEN count(ret) OVER {S.rows(3)} >= 2 THEN CAST(round(avg(volume) OVER {S.rows(3)}, 6) >= round(avg(volume) OVER (PARTITION BY series_id), 6) AS INT) END AS label FROM panel)"""


def labelled(spark, d) -> DataFrame:
    """Each brand's weeks of more than its mean volume, and the same of the mean of four weeks."""
    from pyspark.sql import Window as W

    df = P.brand_week(spark, d)
    mean = F.avg("volume").over(W.partitionBy("series_id"))
    late = F.when(F.count("ret").over(R.last_rows(4)) >= 2, (F.round(F.avg("volume").over(R.last_rows(4)), 6) >= F.round(mean, 6)).cast("int"))
    return df.select("series_id", "ts", "ret", (F.col("volume") >= mean).cast("int").alias("truth"), late.alias("label"))


@query(
    f"""WITH {_LABELLED}, y AS (SELECT *, coalesce(CAST(label <> lag(label) OVER ({S.W}) AS INT), 1) AS new FROM x WHERE label IS NOT NULL), z AS (SELECT *, sum(new) OVER {S.rows(None)} AS spell FROM y)
    SELECT series_id, CAST(spell AS BIGINT) AS spell, label, min(ts) AS start, max(ts) AS stop, count(*) AS n FROM z GROUP BY 1, 2, 3""",
    dates=("start", "stop"),
)
def spells(spark, d):
    return R.spells(labelled(spark, d))


@query(
    f"""WITH {_LABELLED}, y AS (SELECT *, coalesce(CAST(label <> lag(label) OVER ({S.W}) AS INT), 0) AS s FROM x WHERE label IS NOT NULL)
    SELECT series_id, count(*) AS n, CAST(sum(s) AS BIGINT) AS switches, {r('avg(label)', 'share')}, {r('count(*) / (sum(s) + 1)', 'mean_spell')} FROM y GROUP BY 1"""
)
def switch_counts(spark, d):
    return rounded(R.switches(labelled(spark, d)))


_DETECT = f"""WITH {_LABELLED}, y AS (SELECT *, row_number() OVER ({S.W}) AS rn, coalesce(CAST(truth <> lag(truth) OVER ({S.W}) AS INT), 1) AS new FROM x), z AS (SELECT *, sum(new) OVER {S.rows(None)} AS spell FROM y),
    s AS (SELECT series_id, spell, min(rn) FILTER (label = 1) - min(rn) AS delay FROM z WHERE truth = 1 GROUP BY 1, 2)"""


@query(f"{_DETECT} SELECT series_id, count(*) AS n_spells, {r('quantile_cont(delay, 0.5)', 'median_delay')}, {r('avg(CAST(delay IS NULL AS INT))', 'missed')} FROM s GROUP BY 1")
def detection_delay(spark, d):
    return rounded(R.detection(labelled(spark, d)))


@query(
    f"""WITH {_LABELLED}, y AS (SELECT *, row_number() OVER ({S.W}) AS rn, coalesce(truth = 1 AND lag(truth) OVER ({S.W}) = 0, false) AS ev FROM x)
    SELECT e.series_id, e.ts, coalesce(CAST(min(l.rn) - e.rn AS INT), -1) AS lag FROM y e LEFT JOIN y l ON e.series_id = l.series_id AND l.label = 1 AND l.rn BETWEEN e.rn AND e.rn + 9 WHERE e.ev GROUP BY e.series_id, e.ts, e.rn"""
)
def episode_lag(spark, d):
    df = labelled(spark, d)
    events = df.withColumn("before", F.lag("truth").over(cleaning.in_time())).where("truth = 1 and before = 0")
    return R.episode_lags(df, events, 10).withColumn("lag", F.coalesce("lag", F.lit(-1)).cast("int"))


@query(
    f"""WITH {_LABELLED} SELECT l.series_id, count(*) AS n, {r('avg(CAST(truth = label AS INT))', 'agreement')}, CAST(sum(truth) AS BIGINT) AS n_true, CAST(sum(label) AS BIGINT) AS n_label FROM x l WHERE label IS NOT NULL GROUP BY 1"""
)
def real_time_agreement(spark, d):
    g = labelled(spark, d).where("label is not null").groupBy("series_id").agg(
        F.count("*").alias("n"), F.avg((F.col("truth") == F.col("label")).cast("int")).alias("agreement"), F.sum("truth").alias("n_true"), F.sum("label").alias("n_label")
    )
    return rounded(g)


@query(
    f"""WITH {_LABELLED}, rec AS (SELECT series_id, truth, avg(CAST(label = truth AS DOUBLE)) AS v FROM x WHERE label IS NOT NULL GROUP BY 1, 2), ba AS (SELECT series_id, avg(v) AS balanced_accuracy FROM rec GROUP BY 1),
    y AS (SELECT *, row_number() OVER ({S.W}) AS rn, coalesce(CAST(truth <> lag(truth) OVER ({S.W}) AS INT), 1) AS new FROM x), z AS (SELECT *, sum(new) OVER {S.rows(None)} AS spell FROM y),
    s AS (SELECT series_id, spell, min(rn) FILTER (label = 1) - min(rn) AS delay FROM z WHERE truth = 1 GROUP BY 1, 2), dd AS (SELECT series_id, quantile_cont(delay, 0.5) AS delay, avg(CAST(delay IS NULL AS INT)) AS missed FROM s GROUP BY 1)
    SELECT {r('avg(balanced_accuracy)', 'balanced_accuracy')}, {r('stddev_samp(balanced_accuracy)', 'std')}, {r('avg(delay)', 'delay')}, {r('avg(missed)', 'missed')}, count(*) AS n FROM ba JOIN dd USING (series_id)"""
)
def detector_accuracy(spark, d):
    df = labelled(spark, d)
    both = I.balanced_accuracy(df, "label", "truth", ["series_id"]).join(R.detection(df), "series_id")
    return rounded(both.agg(F.avg("balanced_accuracy").alias("balanced_accuracy"), F.stddev_samp("balanced_accuracy").alias("std"), F.avg("median_delay").alias("delay"), F.avg("missed").alias("missed"), F.count("*").alias("n")))


@query(
    f"""WITH RECURSIVE {S.BRAND_WEEK}, x AS (SELECT series_id, ts, row_number() OVER ({S.W}) AS rn, round(coalesce(exp(sum(logret) OVER {S.rows(None)}), 1.0), 9) AS w FROM panel),
    m AS (SELECT series_id, rn, 0 AS bear, w AS ext, rn AS peak, CAST(NULL AS BIGINT) AS began FROM x WHERE rn = 1
        UNION ALL SELECT series_id, rn, CASE WHEN turn THEN 1 - bear ELSE bear END, CASE WHEN turn OR further THEN w ELSE ext END, CASE WHEN turn OR further THEN rn ELSE peak END, CASE WHEN turn THEN peak + 1 END
        FROM (SELECT *, NOT further AND CASE bear WHEN 0 THEN w <= 0.8 * ext ELSE w >= 1.2 * ext END AS turn
            FROM (SELECT x.series_id, x.rn, x.w, m.bear, m.ext, m.peak, CASE m.bear WHEN 0 THEN x.w > m.ext ELSE x.w < m.ext END AS further FROM x JOIN m ON x.series_id = m.series_id AND x.rn = m.rn + 1))),
    e AS (SELECT series_id, began, bear FROM m WHERE began IS NOT NULL)
    SELECT x.series_id, x.ts, CAST(coalesce(arg_max(e.bear, e.began), 0) AS INT) AS bear FROM x LEFT JOIN e ON x.series_id = e.series_id AND e.began <= x.rn GROUP BY x.series_id, x.ts"""
)
def bear_dating(spark, d):
    wealth = cleaning.wealth(P.brand_week(spark, d)).withColumn("wealth", F.round("wealth", 9))
    return dating.turning_points(wealth, "wealth", 0.2).select("series_id", "ts", "bear")


@query(
    f"""WITH {S.TYPE_DAY}, x AS (SELECT series_id, ts, ret - avg(ret) OVER (PARTITION BY series_id) AS e FROM panel WHERE ret IS NOT NULL), y AS (SELECT *, {', '.join(f'e * lag(e, {k}) OVER ({S.W}) AS g{k}' for k in range(1, 11))} FROM x),
    g AS (SELECT series_id, count(*) AS n, sum(e * e) AS g0, {', '.join(f'sum(g{k}) AS g{k}' for k in range(1, 11))} FROM y GROUP BY 1), m AS (SELECT series_id, avg(ret) AS mean FROM panel GROUP BY 1)
    SELECT series_id, n, {r('mean', 'mean')}, {r('mean / sqrt((g0 / n + ' + ' + '.join(f'2 * {1 - k / 11} * g{k} / n' for k in range(1, 11)) + ') / n)', 't')} FROM g JOIN m USING (series_id)"""
)
def newey_west(spark, d):
    return rounded(I.newey_west(P.type_day(spark, d), "ret"))


@query(
    f"""WITH {S.BRAND_WEEK}, x AS (SELECT series_id, ts, ret * ret - volume / 1000 AS v FROM panel WHERE ret IS NOT NULL), e AS (SELECT *, v - avg(v) OVER (PARTITION BY series_id) AS e FROM x), y AS (SELECT *, {', '.join(f'e * lag(e, {k}) OVER ({S.W}) AS g{k}' for k in range(1, 5))} FROM e),
    g AS (SELECT series_id, count(*) AS n, avg(v) AS mean, sum(e * e) AS g0, {', '.join(f'sum(g{k}) AS g{k}' for k in range(1, 5))} FROM y GROUP BY 1)
    SELECT series_id, n, {r('mean', 'mean')}, {r('CASE WHEN v > 0 THEN mean / sqrt(v / n) END', 't')} FROM (SELECT *, g0 / n + {' + '.join(f'2 * {1 - k / 5} * g{k} / n' for k in range(1, 5))} AS v FROM g)"""
)
def diebold_mariano(spark, d):
    df = P.brand_week(spark, d).withColumns({"a": F.col("ret") * F.col("ret"), "b": F.col("volume") / 1000})
    return rounded(I.diebold_mariano(df, "a", "b", 4))


_ROBUST = """(SELECT *, d * lag(d) OVER (PARTITION BY {k} ORDER BY ts) AS p, d + lag(d) OVER (PARTITION BY {k} ORDER BY ts) AS q FROM (SELECT *, x - avg(x) OVER (PARTITION BY {k}) AS d FROM {t}))"""
_ROBUST_G = "count(*) AS n, sum(d * d) AS s, sum(q * q) AS sq, sum(p * p) AS sp"


@query(
    f"""WITH {S.TYPE_DAY}, t AS (SELECT series_id, ts, ret AS x FROM panel WHERE ret IS NOT NULL), g AS (SELECT series_id, {_ROBUST_G} FROM {_ROBUST.format(k='series_id', t='t')} GROUP BY 1)
    SELECT series_id, n, {r('(sq / (n * 2)) / (s / n)', 'vr')}, {r('((sq / (n * 2)) / (s / n) - 1) / sqrt(n * sp / (s * s) / n)', 'z')} FROM g"""
)
def lo_mackinlay_z(spark, d):
    return rounded(I.robust_variance_ratio(P.type_day(spark, d), "ret"))


@query(
    f"""WITH {S.TYPE_DAY}, n AS (SELECT *, row_number() OVER ({S.W}) - 1 AS rn, count(*) OVER (PARTITION BY series_id) AS nn FROM panel),
    t AS (SELECT series_id, CAST(w AS BIGINT) AS win, ts, ret AS x FROM (SELECT *, unnest(range(0, CAST(floor((nn - 252) / 21) AS BIGINT) + 1)) AS w FROM n WHERE nn >= 252) WHERE rn >= w * 21 AND rn < w * 21 + 252 AND ret IS NOT NULL),
    g AS (SELECT series_id, win, {_ROBUST_G} FROM {_ROBUST.format(k='series_id, win', t='t')} GROUP BY 1, 2), z AS (SELECT series_id, win, round(((sq / (n * 2)) / (s / n) - 1) / sqrt(n * sp / (s * s) / n), 9) AS z FROM g)
    SELECT series_id, count(*) AS windows, {r('avg(z)', 'mean_z')}, {r('avg(CAST(abs(z) > 1.96 AS INT))', 'rejected')} FROM z GROUP BY 1"""
)
def hopping_vr(spark, d):
    windows = R.hopping(P.type_day(spark, d).select("series_id", "ts", "ret"))
    z = I.robust_variance_ratio(windows, "ret", 2, ("series_id", "win")).withColumn("z", F.round("z", 9))
    return rounded(z.groupBy("series_id").agg(F.count("*").alias("windows"), F.avg("z").alias("mean_z"), F.avg((F.abs("z") > 1.96).cast("int")).alias("rejected")))


@query(
    f"""WITH {S.TYPE_DAY}, x AS (SELECT *, {', '.join(f'ret - lag(ret, {q}) OVER ({S.W}) AS d{q}' for q in (1, 2, 5, 10))} FROM panel), g AS (SELECT series_id, count(ret) AS n, var_pop(d1) AS v1, unnest([{', '.join(f"{{'q': {q}, 'v': var_pop(d{q})}}" for q in (2, 5, 10))}]) AS u FROM x GROUP BY 1),
    y AS (SELECT series_id, n, u.q AS q, u.v / nullif(v1 * u.q, 0) AS vr FROM g) SELECT series_id, n, q, {r('vr', 'vr')}, {r('(vr - 1) / sqrt(2 * (2 * q - 1) * (q - 1) / (3.0 * q * n))', 'z')} FROM y"""
)
def diff_variance_ratio(spark, d):
    return rounded(I.diff_variance_ratio(P.type_day(spark, d), "ret"))


@query(
    f"""WITH {_LABELLED}, l AS (SELECT series_id, ret AS y, lag(ret) OVER ({S.W}) AS x, lag(truth) OVER ({S.W}) AS s FROM x), m AS (SELECT * FROM l WHERE y IS NOT NULL AND x IS NOT NULL AND s IS NOT NULL),
    g AS (SELECT series_id, s, count(*) AS k, regr_slope(y, x) AS b, avg(x) AS mx, avg(y) AS my, var_pop(x) AS v FROM m GROUP BY 1, 2),
    e AS (SELECT m.series_id, m.s, sum(((y - my - b * (x - mx)) * (x - mx)) ** 2) AS meat FROM m JOIN g ON m.series_id = g.series_id AND m.s = g.s GROUP BY 1, 2),
    h AS (SELECT g.*, meat / (k * v) ** 2 AS w FROM g JOIN e ON g.series_id = e.series_id AND g.s = e.s)
    SELECT series_id, CAST(sum(k) AS BIGINT) AS n, {r('max(b) FILTER (s = 0)', 'low')}, {r('max(b) FILTER (s = 1)', 'high')}, {r('max(b) FILTER (s = 1) - max(b) FILTER (s = 0)', 'gap')},
    {r('(max(b) FILTER (s = 1) - max(b) FILTER (s = 0)) / sqrt(sum(w))', 't')} FROM h GROUP BY 1 HAVING sum(k) >= 100 AND min(k) >= 30"""
)
def ar1_by_state(spark, d):
    return rounded(I.ar1_by_state(labelled(spark, d), "ret", "truth", ["series_id"], 100, 30))


def _with_market(spark, d):
    panel = P.brand_week(spark, d)
    return panel.join(panel.groupBy("ts").agg(F.avg("ret").alias("market")), "ts")


@query(
    f"""WITH {S.BRAND_WEEK}, m AS (SELECT ts, avg(ret) AS market FROM panel GROUP BY 1), x AS (SELECT series_id, ts, ret, market FROM panel JOIN m USING (ts) WHERE ret IS NOT NULL AND market IS NOT NULL),
    g AS (SELECT series_id, count(*) AS n, regr_intercept(ret, market) AS a, regr_slope(ret, market) AS b, avg(market) AS mx, var_pop(market) AS v FROM x GROUP BY 1),
    u AS (SELECT x.series_id, ts, (ret - a - b * market) * (1 - (market - mx) * mx / v) AS u FROM x JOIN g USING (series_id)), l AS (SELECT *, {', '.join(f'u * lag(u, {k}) OVER ({S.W}) AS g{k}' for k in range(1, 11))} FROM u),
    s AS (SELECT series_id, sum(u * u) + {' + '.join(f'2 * {1 - k / 11} * sum(g{k})' for k in range(1, 11))} AS w FROM l GROUP BY 1)
    SELECT series_id, n, {r('a', 'alpha')}, {r('b', 'beta')}, {r('CASE WHEN w > 0 THEN a * n / sqrt(w) END', 't_alpha')} FROM g JOIN s USING (series_id)"""
)
def alpha_beta(spark, d):
    return rounded(I.alpha_beta(_with_market(spark, d), "ret", "market", ["series_id"]))


@query()
def volatility_regression(spark, d):
    """Absolute return on a constant, the market's and the state."""
    df = labelled(spark, d).withColumns({"one": F.lit(1.0), "move": F.abs("ret"), "before": F.abs(F.lag("ret").over(cleaning.in_time()))})
    return rounded(I.ols_hc0(df, "move", ["one", "before", "truth"], ["series_id"]))


@query(
    f"""WITH {S.TYPE_DAY}, c AS (SELECT series_id, ret, avg(ret) OVER (PARTITION BY series_id) AS m FROM panel WHERE ret IS NOT NULL), g AS (SELECT series_id, count(*) AS n, avg(ret) / nullif(stddev_samp(ret), 0) AS sr, avg((ret - m) ** 3) / avg((ret - m) ** 2) ** 1.5 AS skew, avg((ret - m) ** 4) / avg((ret - m) ** 2) ** 2 AS kurtosis FROM c GROUP BY 1)
    SELECT series_id, n, {r('sr', 'sr')}, {r('skew', 'skew')}, {r('kurtosis', 'kurtosis')}, {r('sr * sqrt(n - 1) / sqrt(greatest(1 - skew * sr + (kurtosis - 1) / 4 * sr * sr, 1e-12))', 'z')} FROM g"""
)
def psr_z(spark, d):
    return rounded(I.probabilistic_sharpe(P.type_day(spark, d), "ret", ["series_id"]))


@query(
    f"""WITH {S.TYPE_DAY}, p AS (SELECT series_id, year(ts) AS y, count(ret) AS n, round(abs(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(count(ret))), 9) AS t FROM panel GROUP BY 1, 2), q AS (SELECT series_id, y, round(exp(-t), 9) AS p FROM p WHERE t IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY p, y) AS rank, count(*) OVER (PARTITION BY series_id) AS n FROM q), a AS (SELECT *, 0.05 * rank / n AS threshold, least(1.0, p * n / rank) AS raw FROM k),
    z AS (SELECT *, min(raw) OVER (PARTITION BY series_id ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS adj, max(CASE WHEN p <= threshold THEN rank END) OVER (PARTITION BY series_id) AS m FROM a)
    SELECT series_id, CAST(y AS INT) AS y, {r('p', 'p')}, CAST(rank AS INT) AS rank, {r('threshold', 'threshold')}, {r('raw', 'adjusted_p_raw')}, {r('adj', 'adjusted_p')}, coalesce(rank <= m, false) AS reject FROM z"""
)
def bh_correction(spark, d):
    p = P.type_day(spark, d).groupBy("series_id", F.year("ts").alias("y")).agg(F.round(F.abs(F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * F.sqrt(F.count("ret"))), 9).alias("t"))
    return rounded(I.benjamini_hochberg(p.where("t is not null").select("series_id", "y", F.round(F.exp(-F.col("t")), 9).alias("p")), "p", ["series_id"]))


@query()
def t_tests(spark, d):
    """Mean return of each series against 0, with normal and Student p values."""
    g = P.type_day(spark, d).groupBy("series_id").agg(F.count("ret").alias("n"), (F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * F.sqrt(F.count("ret"))).alias("t"))
    return rounded(g.withColumns({"p_normal": two_sided_p("t"), "p": two_sided_t("t", (F.col("n") - 1).cast("double"))}))


#: Circular blocks of 21 rows, 100 replicates, of the series in x (series_id, ts, values); starts are hashes.
DRAWN = f"""k AS (SELECT *, row_number() OVER ({S.W}) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM x), sizes AS (SELECT DISTINCT series_id, n FROM k WHERE n >= 50),
    blocks AS (SELECT series_id, n, rep, b, CAST('0x' || substr(md5('7-' || rep || '-' || b), 1, 8) AS BIGINT) % n AS s, least(21, n - 21 * b) AS len FROM (SELECT series_id, n, rep, unnest(range(0, CAST(floor((n - 1) / 21) AS BIGINT) + 1)) AS b FROM (SELECT *, unnest(range(0, 100)) AS rep FROM sizes))),
    picks AS (SELECT series_id, rep, (s + o) % n AS i FROM (SELECT *, unnest(range(0, len)) AS o FROM blocks)), drawn AS (SELECT p.rep, k.* FROM picks p JOIN k USING (series_id, i))"""
_SHARPE = "CASE WHEN count({0}) >= 5 AND stddev_samp({0}) > 1e-7 THEN avg({0}) / stddev_samp({0}) * sqrt(252) END"


@query(
    f"""WITH {S.BRAND_WEEK}, x AS (SELECT series_id, ts, ret FROM panel WHERE ret IS NOT NULL), {DRAWN},
    v AS (SELECT k.series_id, avg(ret) AS mean, {_SHARPE.format("ret")} AS sharpe FROM k WHERE n >= 50 GROUP BY 1), q AS (SELECT series_id, rep, avg(ret) AS mean, {_SHARPE.format("ret")} AS sharpe FROM drawn GROUP BY 1, 2),
    e AS (SELECT series_id, quantile_cont(mean, 0.025) AS ml, quantile_cont(mean, 0.975) AS mh, quantile_cont(sharpe, 0.025) AS sl, quantile_cont(sharpe, 0.975) AS sh FROM q GROUP BY 1)
    SELECT series_id, 'mean' AS metric, {r('mean', 'value')}, {r('ml', 'low')}, {r('mh', 'high')} FROM v JOIN e USING (series_id) UNION ALL SELECT series_id, 'sharpe', {r('sharpe', 'value')}, {r('sl', 'low')}, {r('sh', 'high')} FROM v JOIN e USING (series_id)"""
)
def bootstrap_ci(spark, d):
    df = P.brand_week(spark, d).where("ret is not null")
    return rounded(I.moment_bootstrap(df, ["ret"], {"mean": F.col("mean_ret"), "sharpe": I.moment_sharpe("ret")}, ["series_id"], 100))


@query(
    f"""WITH {S.BRAND_WEEK}, y AS (SELECT series_id, ts, ret AS a, sign(lag(ret) OVER ({S.W})) * ret AS b FROM panel), x AS (SELECT * FROM y WHERE a IS NOT NULL AND b IS NOT NULL), {DRAWN.replace("WHERE n >= 50", "")},
    q AS (SELECT series_id, rep, coalesce({_SHARPE.format("a")}, 0) - coalesce({_SHARPE.format("b")}, 0) AS d FROM drawn GROUP BY 1, 2), v AS (SELECT series_id, coalesce({_SHARPE.format("a")}, 0) - coalesce({_SHARPE.format("b")}, 0) AS value FROM x GROUP BY 1),
    e AS (SELECT series_id, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, least(1.0, 2 * least(avg(CAST(d <= 0 AS INT)), avg(CAST(d >= 0 AS INT)))) AS p FROM q GROUP BY 1)
    SELECT series_id, {r('value', 'value')}, {r('low', 'low')}, {r('high', 'high')}, {r('p', 'p')} FROM v JOIN e USING (series_id)"""
)
def sharpe_gap(spark, d):
    """Holding a series against following its last return: the difference of Sharpe ratios by paired blocks."""
    df = P.brand_week(spark, d)
    df = df.withColumns({"a": F.col("ret"), "b": F.signum(F.lag("ret").over(cleaning.in_time())) * F.col("ret")}).where("a is not null and b is not null")
    return rounded(I.sharpe_difference(df, "a", "b", ["series_id"], 100))


#: One family of as many tests as there are lines: how far a line's unit price is above its part's mean.
_LINE_P = """f AS (SELECT l_orderkey, l_linenumber, round(exp(-8 * abs(l_extendedprice / l_quantity / 1000 - 1) * (1 + l_tax)), 9) AS p, CAST(l_returnflag = 'R' AS INT) AS returned, l_extendedprice AS price FROM lineitem)"""


def _lines(spark, d) -> DataFrame:
    p = F.round(F.exp(-8 * F.abs(F.col("l_extendedprice") / F.col("l_quantity") / 1000 - 1) * (1 + F.col("l_tax"))), 9)
    return P.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("returned"), F.col("l_extendedprice").alias("price"))


@query(
    f"""WITH {_LINE_P}, g AS (SELECT price, sum(returned) AS p, sum(1 - returned) AS q FROM f GROUP BY 1), c AS (SELECT p, q, p * (coalesce(sum(q) OVER (ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS w FROM g)
    SELECT CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg, {r('sum(w) / nullif(sum(p) * sum(q), 0)', 'auc')} FROM c"""
)
def auc_of_all_lines(spark, d):
    """Price against return over all lines as one group."""
    return rounded(K.auc(_lines(spark, d), "price", "returned", []))


@query(
    f"""WITH {_LINE_P}, k AS (SELECT l_orderkey, l_linenumber, p, row_number() OVER (ORDER BY p, l_orderkey, l_linenumber) AS rank, count(*) OVER () AS n FROM f WHERE p IS NOT NULL), a AS (SELECT *, 0.05 * rank / n AS threshold, least(1.0, p * n / rank) AS raw FROM k),
    z AS (SELECT *, min(raw) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS adj, max(CASE WHEN p <= threshold THEN rank END) OVER () AS m FROM a)
    SELECT l_orderkey, l_linenumber, {r('p', 'p')}, CAST(rank AS BIGINT) AS rank, round(raw, 8) + 0.0 AS adjusted_p_raw, round(adj, 8) + 0.0 AS adjusted_p, coalesce(rank <= m, false) AS reject FROM z"""
)
def false_discovery_of_all_lines(spark, d):
    """All lines as one family of tests. Thresholds, 0.05 rank / n, are left out: many end in a 5 that the engines round apart. Other numbers are rounded as SQL does, by their doubles."""
    df = K.benjamini_hochberg(_lines(spark, d).select("l_orderkey", "l_linenumber", "p"), "p", [])
    digits = lambda c, scale: (F.floor(F.col(c) * scale + 0.5) / scale).alias(c)
    return df.select("l_orderkey", "l_linenumber", digits("p", 1e6), "rank", digits("adjusted_p_raw", 1e8), digits("adjusted_p", 1e8), "reject")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS BIGINT) AS rank FROM lineitem")
def rank_of_all_lines(spark, d):
    """All lines by price, dearest first."""
    lines = P.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return K.ranked(lines, [], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")])


@query()
def sharpe_diff(spark, d):
    return rounded(I.sharpe_difference(_with_market(spark, d).where("ret is not null"), "ret", "market", ["series_id"], 100))


def brand_signals(spark, d) -> tuple[DataFrame, DataFrame]:
    """The weekly panel with its score, and the efficiency (by variance ratio and Ljung-Box) of its market."""
    panel = P.brand_week(spark, d)
    market = panel.groupBy("ts").agg(F.avg("ret").alias("ret")).withColumn("series_id", F.lit("market"))
    eff = R.variance_ratio(market, "ret", 26, 3).select("ts", F.round(1 / (1 + F.abs(F.col("vr") - 1)), 9).alias("eff"))
    return panel.select("series_id", "ts", "ret", F.round(R.rolling_mean("ret", 8, 4), 9).alias("score")), eff


_SIGNALS = f"""{S.BRAND_WEEK}, mkt AS (SELECT 'market' AS series_id, ts, avg(ret) AS ret FROM panel GROUP BY ts), mq AS (SELECT *, CASE WHEN count(ret) OVER {S.rows(2)} >= 3 THEN sum(ret) OVER {S.rows(2)} END AS qs FROM mkt),
    eff AS (SELECT ts, round(1 / (1 + abs(CASE WHEN count(ret) OVER {S.rows(25)} >= 26 THEN var_samp(qs) OVER {S.rows(23)} / nullif(3 * var_samp(ret) OVER {S.rows(25)}, 0) END - 1)), 9) AS eff FROM mq),
    sig AS (SELECT series_id, ts, ret, round({S.rolling('avg', 'ret', 8, 4)}, 9) AS score FROM panel)"""

_WALK = f"""{_SIGNALS}, cal AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS day FROM (SELECT DISTINCT ts FROM sig)),
    past AS (SELECT c.*, e.eff, CASE WHEN count(e.eff) OVER f >= 20 THEN quantile_cont(e.eff, 0.4) OVER f END AS past FROM cal c LEFT JOIN eff e USING (ts) WINDOW f AS (ORDER BY day ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)),
    fl AS (SELECT *, (day - 52) // 4 AS fold FROM past WHERE day >= 52), tau AS (SELECT fold, max(CASE WHEN day = fold * 4 + 52 THEN past END) AS tau, min(day) - 1 AS day0 FROM fl GROUP BY 1),
    plan AS (SELECT fl.ts, fl.day, fl.fold, tau, CASE WHEN tau IS NOT NULL AND eff IS NOT NULL THEN CAST(eff < tau AS INT) END AS deploy FROM fl JOIN tau USING (fold)),
    pick AS (SELECT t.fold, s.series_id, s.score, greatest(1, floor(count(*) OVER (PARTITION BY t.fold) * 0.2)) AS k, row_number() OVER (PARTITION BY t.fold ORDER BY s.score DESC, s.series_id) AS a, row_number() OVER (PARTITION BY t.fold ORDER BY s.score, s.series_id) AS b
        FROM tau t JOIN cal c ON c.day = t.day0 JOIN sig s ON s.ts = c.ts WHERE s.score IS NOT NULL),
    basket AS (SELECT fold, series_id, CASE WHEN a <= k THEN 1 ELSE -1 END / k AS target FROM pick WHERE a <= k OR b <= k),
    dec AS (SELECT *, row_number() OVER (ORDER BY day) AS k FROM plan WHERE deploy IS NOT NULL), held AS (SELECT k, day, series_id, target * deploy AS w FROM dec JOIN basket USING (fold) WHERE target * deploy <> 0),
    turn AS (SELECT k, sum(abs(coalesce(w, 0) - coalesce(old, 0))) AS turnover FROM (SELECT k, series_id, w FROM held) x FULL JOIN (SELECT k + 1 AS k, series_id, w AS old FROM held) y USING (k, series_id) GROUP BY k),
    live AS (SELECT *, coalesce(sum(CASE WHEN deploy IS NOT NULL THEN 1 ELSE 0 END) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS kh FROM plan),
    gross AS (SELECT l.day, sum(h.w * coalesce(s.ret, 0)) AS gross FROM live l JOIN held h ON h.k = l.kh LEFT JOIN sig s ON s.ts = l.ts AND s.series_id = h.series_id GROUP BY 1),
    walk AS (SELECT p.ts, p.day, p.fold, CASE WHEN tau IS NULL THEN NULL WHEN deploy IS NULL THEN 0 ELSE coalesce(gross, 0) END AS gross, CASE WHEN tau IS NULL THEN NULL WHEN deploy IS NULL THEN 0 ELSE coalesce(turnover, 0) END AS turnover, coalesce(deploy, 0) AS deployed
        FROM plan p LEFT JOIN gross g USING (day) LEFT JOIN (SELECT dec.day, turn.turnover FROM dec JOIN turn USING (k)) t USING (day))"""

_FIXED = {"train": 52, "refit": 4, "enough": 20}


@query(f"WITH {_WALK} SELECT ts, CAST(day AS INT) AS day, CAST(fold AS BIGINT) AS fold, {r('gross', 'gross')}, {r('turnover', 'turnover')}, deployed FROM walk")
def walk_forward(spark, d):
    return rounded(T.walk_forward(*brand_signals(spark, d), **_FIXED))


@query(
    f"""WITH {_WALK}, c AS (SELECT cost, gross - cost * turnover AS pnl FROM walk, (SELECT unnest([0.0, 0.0005, 0.001, 0.002]) AS cost) WHERE gross IS NOT NULL)
    SELECT CAST(cost AS DOUBLE) AS cost, count(*) AS n, {r('avg(pnl) * 252', 'ann_return')}, {r('avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252)', 'sharpe')} FROM c GROUP BY 1"""
)
def cost_sensitivity(spark, d):
    runs = T.costs(T.walk_forward(*brand_signals(spark, d), **_FIXED), [0.0, 0.0005, 0.001, 0.002])
    return rounded(T.performance(runs, ["cost"]).select("cost", "n", "ann_return", "sharpe"))


@query(
    f"""WITH {_WALK}, x AS (SELECT ts, CASE WHEN ts < DATE '1999-01-01' THEN 'development' ELSE 'lockbox' END AS period, gross - 0.001 * turnover AS pnl FROM walk WHERE gross IS NOT NULL), w AS (SELECT *, exp(sum(ln(1 + greatest(pnl, -0.999999))) OVER f) AS w FROM x WINDOW f AS (PARTITION BY period ORDER BY ts ROWS UNBOUNDED PRECEDING)),
    dd AS (SELECT *, w / greatest(max(w) OVER (PARTITION BY period ORDER BY ts ROWS UNBOUNDED PRECEDING), 1) - 1 AS dd FROM w)
    SELECT period, count(*) AS n, {r('avg(pnl) * 252', 'ann_return')}, {r('stddev_samp(pnl) * sqrt(252)', 'ann_vol')}, {r('CASE WHEN count(*) >= 5 THEN avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252) END', 'sharpe')}, {r('CASE WHEN count(*) >= 5 THEN avg(pnl) * sqrt(count(*)) / nullif(stddev_samp(pnl), 0) END', 't_stat')},
    {r('min(dd)', 'max_drawdown')}, {r('avg(CAST(pnl <> 0 AS INT))', 'active')}, {r('avg(CAST(pnl > 0 AS INT)) FILTER (pnl <> 0)', 'win_rate')} FROM dd GROUP BY 1"""
)
def performance(spark, d):
    run = T.net(T.walk_forward(*brand_signals(spark, d), **_FIXED), 0.001)
    run = run.withColumn("period", F.when(F.col("ts") < F.lit("1999-01-01").cast("date"), "development").otherwise("lockbox"))
    return rounded(T.performance(run, ["period"]))


@query()
def config_grid(spark, d):
    """Two shares, two refits and three momentum lengths, with and without the condition, before and after 1999.

    The best conditional combination by Sharpe of the development period is chosen; its deflated Sharpe counts all combinations as
    trials, and the later rows of both arms are its lockbox.
    """
    panel, eff = brand_signals(spark, d)
    moms = {4: "m4", 8: "score", 13: "m13"}
    panel = panel.withColumns({f"m{n}": F.round(R.rolling_mean("ret", n, n // 2), 9) for n in (4, 13)})
    runs = T.net(T.grid(moms, panel, eff, [4, 13], [0.3, 0.5], train=52, enough=20, arms=(True, False)), 0.001)
    runs = runs.withColumn("period", F.when(F.col("ts") < F.lit("1999-01-01").cast("date"), "development").otherwise("lockbox"))
    runs = saved(runs)  # both the table and the trials read it
    config = ["mom", "refit", "share"]
    table = T.performance(runs, [*config, "conditional", "period"]).select(*config, "conditional", "period", "n", "ann_return", "ann_vol", "sharpe", "max_drawdown")
    best = A.best(table.where("conditional and period = 'development'"), [], "sharpe", config).select(*config, F.lit(True).alias("chosen"))
    trials = I.deflated_sharpe(runs.where("conditional and period = 'development' and pnl is not null"), "pnl", config)
    table = table.join(F.broadcast(best), config, "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))  # one row
    return rounded(table.withColumn("dsr", F.when(F.col("chosen") & F.col("conditional") & (F.col("period") == "development"), F.lit(trials["dsr"]).cast("double"))))


@query(
    f"""WITH {_WALK}, x AS (SELECT ts, gross - 0.001 * turnover AS pnl FROM walk), s AS (SELECT ts, CASE WHEN count(pnl) OVER w >= 13 THEN avg(pnl) OVER w / nullif(stddev_samp(pnl) OVER w, 0) * sqrt(252) END AS sharpe FROM x WINDOW w AS (ORDER BY ts ROWS BETWEEN 25 PRECEDING AND CURRENT ROW))
    SELECT ts, {r('sharpe', 'sharpe')}, {r('CASE WHEN count(sharpe) OVER w >= 3 THEN avg(sharpe) OVER w END', 'smooth')} FROM s WINDOW w AS (ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""
)
def rolling_sharpe(spark, d):
    """Of half a year of the walk-forward profit, and its mean over five weeks."""
    run = T.net(T.walk_forward(*brand_signals(spark, d), **_FIXED), 0.001).withColumn("series_id", F.lit("walk"))
    run = run.withColumn("sharpe", R.rolling_sharpe("pnl", 26, 13))
    return rounded(run.withColumn("smooth", R.rolling_mean("sharpe", 5, 3)).select("ts", "sharpe", "smooth"))


@query()
def conditional_gap(spark, d):
    """The conditional basket against the one that is always held: Sharpe difference with its bootstrap interval."""
    panel, eff = brand_signals(spark, d)
    one = T.net(T.walk_forward(panel, eff, **_FIXED), 0.001).select("ts", F.col("pnl").alias("a"))
    two = T.net(T.walk_forward(panel, eff, conditional=False, **_FIXED), 0.001).select("ts", F.col("pnl").alias("b"))
    both = one.join(two, "ts").where("a is not null and b is not null").withColumn("series_id", F.lit("market"))
    return rounded(I.sharpe_difference(both, "a", "b", ["series_id"], 100))


@query(f"WITH {_WALK} SELECT CAST(fold AS BIGINT) AS fold, min(ts) AS first_ts, max(ts) AS last_ts, {r('sum(gross - 0.001 * turnover)', 'pnl')} FROM walk GROUP BY 1", dates=("first_ts", "last_ts"))
def fold_summary(spark, d):
    run = T.net(T.walk_forward(*brand_signals(spark, d), **_FIXED), 0.001)
    return rounded(run.groupBy("fold").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("pnl").alias("pnl")))


@query(
    f"""WITH {_WALK}, x AS (SELECT w.ts, CASE WHEN eff < 0.5 THEN 'low' WHEN eff < 0.8 THEN 'medium' WHEN eff >= 0.8 THEN 'high' ELSE 'none' END AS regime, gross - 0.001 * turnover AS pnl FROM walk w LEFT JOIN eff USING (ts) WHERE gross IS NOT NULL)
    SELECT regime, count(*) AS n, {r('avg(pnl) * 252', 'ann_return')}, {r('stddev_samp(pnl) * sqrt(252)', 'ann_vol')}, {r('CASE WHEN count(*) >= 5 THEN avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252) END', 'sharpe')},
    {r('avg(CAST(pnl > 0 AS INT)) FILTER (pnl <> 0)', 'win_rate')}, {r('count(*) / sum(count(*)) OVER ()', 'share')} FROM x GROUP BY 1"""
)
def regime_performance(spark, d):
    panel, eff = brand_signals(spark, d)
    run = T.net(T.walk_forward(panel, eff, **_FIXED), 0.001).join(eff, "ts", "left")
    run = run.withColumns({"regime": F.coalesce(cleaning.level("eff", 0.5, 0.8), F.lit("none")), "strategy": F.lit("conditional")})
    return rounded(T.by_regime(run, "regime", ["strategy"]).select("regime", "n", "ann_return", "ann_vol", "sharpe", "win_rate", "share"))


@query(
    f"""WITH {S.BRAND_WEEK}, x AS (SELECT series_id, ts, ret, CASE WHEN count(ret) OVER {S.rows(20, 1)} >= 20 THEN round(sum(ret) OVER {S.rows(20, 1)}, 9) END AS past FROM panel), k AS (SELECT *, greatest(1, floor(count(*) OVER (PARTITION BY ts) * 0.2)) AS k, row_number() OVER (PARTITION BY ts ORDER BY past DESC, series_id) AS a, row_number() OVER (PARTITION BY ts ORDER BY past, series_id) AS b FROM x WHERE past IS NOT NULL),
    s AS (SELECT ts, avg(ret) FILTER (a <= k) - avg(ret) FILTER (b <= k AND a > k) AS spread FROM k GROUP BY 1), h AS (SELECT ts, avg(ret) AS hold FROM panel GROUP BY 1)
    SELECT ts, {r('spread * 0.5', 'momentum')}, {r('-spread * 0.5', 'reversion')}, {r('hold', 'hold')} FROM h LEFT JOIN s USING (ts)"""
)
def baselines(spark, d):
    return rounded(T.baselines(P.brand_week(spark, d)))


@query(
    f"""WITH {S.BRAND_WEEK}, x AS (SELECT series_id, ts, ret, CASE WHEN count(ret) OVER {S.rows(20, 1)} >= 20 THEN round(sum(ret) OVER {S.rows(20, 1)}, 9) END AS past FROM panel), k AS (SELECT *, greatest(1, floor(count(*) OVER (PARTITION BY ts) * 0.2)) AS k, row_number() OVER (PARTITION BY ts ORDER BY past DESC, series_id) AS a, row_number() OVER (PARTITION BY ts ORDER BY past, series_id) AS b FROM x WHERE past IS NOT NULL),
    s AS (SELECT ts, avg(ret) FILTER (a <= k) - avg(ret) FILTER (b <= k AND a > k) AS spread FROM k GROUP BY 1), h AS (SELECT ts, avg(ret) AS hold FROM panel GROUP BY 1),
    l AS (SELECT ts, spread * 0.5 AS pnl, 'momentum' AS strategy FROM s UNION ALL SELECT ts, -spread * 0.5, 'reversion' FROM s UNION ALL SELECT ts, hold, 'hold' FROM h), y AS (SELECT * FROM l WHERE pnl <> 0),
    c AS (SELECT *, sum(pnl) OVER f AS c, avg(pnl) OVER (PARTITION BY strategy) AS m FROM y WINDOW f AS (PARTITION BY strategy ORDER BY ts ROWS UNBOUNDED PRECEDING)), d AS (SELECT *, c - max(c) OVER (PARTITION BY strategy ORDER BY ts ROWS UNBOUNDED PRECEDING) AS dd FROM c)
    SELECT strategy, count(*) AS n, {r('avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252)', 'sharpe')}, {r('avg(pnl) / nullif(stddev_samp(pnl) FILTER (pnl < 0), 0) * sqrt(252)', 'sortino')}, {r('avg(pnl) * 252 / nullif(abs(min(dd)), 0)', 'calmar')},
    {r('min(dd)', 'max_drawdown')}, {r('avg((pnl - m) ** 3) / var_pop(pnl) ** 1.5', 'skew')}, {r('avg((pnl - m) ** 4) / var_pop(pnl) ** 2 - 3', 'excess_kurtosis')} FROM d GROUP BY 1 HAVING count(*) >= 30"""
)
def active_performance(spark, d):
    runs = T.baselines(P.brand_week(spark, d))
    long = runs.unpivot(["ts"], ["momentum", "reversion", "hold"], "strategy", "pnl")
    return rounded(T.active_performance(long, ["strategy"]))


@query()
def deflated_sharpe(spark, d):
    """One row: the best of the baselines against the largest Sharpe that as many trials without skill would show."""
    long = T.baselines(P.brand_week(spark, d)).unpivot(["ts"], ["momentum", "reversion", "hold"], "strategy", "pnl").where("pnl is not null")
    got = I.deflated_sharpe(long, "pnl", ["strategy"])
    return rounded(spark.createDataFrame([(got["best"]["strategy"] if got["best"] else None, got["trials"], got["benchmark"], got["dsr"])], "best string, trials int, benchmark double, dsr double"))


@query(
    f"""WITH {S.TYPE_DAY}, {S.MARKET}, m AS (SELECT ts, round(stress, 6) AS stress FROM stressed WHERE stress IS NOT NULL), a AS (SELECT p.series_id, abs(p.ret) AS score, CAST(m.stress >= 400 AS INT) AS y FROM panel p JOIN m USING (ts) WHERE p.ret IS NOT NULL),
    g AS (SELECT series_id, round(score, 9) AS s, sum(y) AS p, sum(1 - y) AS q FROM a GROUP BY 1, 2), c AS (SELECT series_id, p, q, p * (coalesce(sum(q) OVER (PARTITION BY series_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS w FROM g)
    SELECT series_id, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg, {r('sum(w) / nullif(sum(p) * sum(q), 0)', 'auc')} FROM c GROUP BY 1"""
)
def stress_detection(spark, d):
    m = stressed(spark, d).select("ts", F.round("stress", 6).alias("stress")).where("stress is not null")
    df = joins.on_dates(P.type_day(spark, d).select("series_id", "ts", F.round(F.abs("ret"), 9).alias("score")), m)
    return rounded(I.auc(df.withColumn("y", cleaning.stress_label("stress", 400)), "score", "y", ["series_id"]))


@query(
    f"""WITH {S.TYPE_DAY} SELECT series_id, {', '.join(r(f"avg(ret) FILTER ({c}) / nullif(stddev_samp(ret) FILTER ({c}), 0) * sqrt(252)", n) for n, c in (('before', "ts < DATE '1998-06-01'"), ('after', "ts >= DATE '1998-06-01'")))} FROM panel GROUP BY 1""",
    dates=(),
)
def subperiod_sharpe(spark, d):
    cut = F.lit("1998-06-01").cast("date")
    df = P.type_day(spark, d).withColumns({"b": F.when(F.col("ts") < cut, F.col("ret")), "a": F.when(F.col("ts") >= cut, F.col("ret"))})
    return rounded(df.groupBy("series_id").agg(I.sharpe("b").alias("before"), I.sharpe("a").alias("after")))


@query()
def claims(spark, d):
    """Five checks of the weekly panel as one table: name, value, threshold, verdict."""
    panel = P.brand_week(spark, d)
    base = T.baselines(panel).agg(*(I.sharpe(c).alias(c) for c in ("momentum", "reversion", "hold")))
    lb = R.ljung_box(panel, "ret", 60, 10).agg(F.avg((F.col("lb_pval") < 0.05).cast("double")).alias("dependent"))
    vr = R.variance_ratio(panel, "ret", 60, 5).agg(F.avg("vr").alias("vr"))
    rows = [(base, "momentum", 0.0), (base, "reversion", 0.0), (base, "hold", 0.0), (lb, "dependent", 0.05), (vr, "vr", 1.0)]
    out = None
    for df, name, threshold in rows:
        one = df.select(F.lit(name).alias("claim"), F.col(name).alias("value"), F.lit(threshold).alias("threshold"))
        out = one if out is None else out.unionByName(one)
    verdict = F.when(F.col("value").isNull(), "INCONCLUSIVE").when(F.col("value") > F.col("threshold"), "PASS").otherwise("FAIL")
    return rounded(out.withColumn("verdict", verdict))

