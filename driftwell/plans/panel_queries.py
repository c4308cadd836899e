"""Queries of cleaning, rolling, cross-section and composite operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.operators import aggregates as A
from driftwell.operators import behavior as B
from driftwell.operators import blocks, cleaning, joins
from driftwell.operators import efficiency as E
from driftwell.operators import rolling as R
from driftwell.plans import fixtures as S
from driftwell.sources import panel as P

QUERIES: dict = {}
SQL: dict[str, str] = {}
DATES: dict[str, tuple[str, ...]] = {}
#: Digits kept of computed numbers, in both engines.
D = 6


def query(sql: str | None = None, dates: tuple[str, ...] | None = None):
    """Registers a query, its SQL, and which of its columns are dates; by default ts, where the SQL's last list has it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
            DATES[f.__name__] = dates if dates is not None else last_dates(sql)
        return f

    return add


def last_dates(sql: str) -> tuple[str, ...]:
    """ts, if the last SELECT outside parentheses has it."""
    depth, at = 0, 0
    for m in re.finditer(r"[()]|\bSELECT\b", sql):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if m[0] == "SELECT" and depth == 0:
            at = m.start()
    return ("ts",) if re.search(r"\bts\b", sql[at:].split(" FROM ")[0]) else ()


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with doubles rounded, or only those of ``columns``; minus zero is zero."""
    names = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, D) + F.lit(0.0) for c in names})


def r(x: str, name: str) -> str:
    return f"round({x}, {D}) + 0.0 AS {name}"


@query(f"WITH {S.TYPE_DAY} SELECT series_id, ts, round(price + 1.23e-6, 4) AS price, round(volume, 3) AS volume, round(dollar_volume, 4) AS dollar_volume, {r('ret', 'ret')}, {r('logret', 'logret')} FROM panel")
def panel_daily_type(spark: SparkSession, d: str) -> DataFrame:
    # prices end in halves of a digit now and then, which two engines round apart; a little more than the half does not
    df = P.type_day(spark, d).withColumns({"price": F.round(F.col("price") + 1.23e-6, 4), "volume": F.round("volume", 3), "dollar_volume": F.round("dollar_volume", 4)})
    return rounded(df, "ret", "logret")


@query(f"WITH {S.BRAND_WEEK} SELECT series_id, ts, {r('ret', 'ret')} FROM panel")
def simple_return(spark, d):
    return rounded(P.brand_week(spark, d).select("series_id", "ts", "ret"))


@query(f"WITH {S.SEGMENT_DAY} SELECT series_id, ts, {r('100 * logret', 'logret')} FROM panel")
def log_return(spark, d):
    return rounded(cleaning.log_return(P.segment_day(spark, d), scale=100.0).select("series_id", "ts", "logret"))


_RATIOS = "[1/4, 1/3, 1/2, 2/3, 3/2, 2.0, 3.0, 4.0]"


@query(
    f"WITH {S.TYPE_DAY} SELECT series_id, ts, round(CASE WHEN NOT (abs(ret) > 0.4 AND len(list_filter({_RATIOS}, lambda x: abs((1 + ret) / x - 1) < 0.02)) > 0) THEN ret END, {D}) + 0.0 AS ret FROM panel"
)
def split_mask(spark, d):
    return rounded(cleaning.split_mask(P.type_day(spark, d)).select("series_id", "ts", "ret"))


@query(
    f"WITH {S.SEGMENT_DAY} SELECT series_id, ts, {r('price', 'price')} FROM panel WHERE series_id IN (SELECT series_id FROM panel GROUP BY 1 HAVING count(price) >= 0.712 * (SELECT count(DISTINCT ts) FROM panel))"
)
def coverage_filter(spark, d):
    return rounded(cleaning.covered(P.segment_day(spark, d), 0.712).select("series_id", "ts", "price"))


@query(f"WITH {S.SEGMENT_DAY} SELECT series_id, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM panel GROUP BY 1", dates=("first_ts", "last_ts"))
def coverage_summary(spark, d):
    return P.coverage_summary(P.segment_day(spark, d))


_SPINE = f"""{S.SEGMENT_DAY}, spine AS (
    SELECT series_id, CAST(unnest(generate_series((SELECT min(ts) FROM panel), (SELECT max(ts) FROM panel), INTERVAL 1 DAY)) AS DATE) AS ts FROM (SELECT DISTINCT series_id FROM panel)
), daily AS (SELECT s.series_id, s.ts, p.price FROM (SELECT * FROM spine WHERE isodow(ts) < 6) s LEFT JOIN panel p USING (series_id, ts))"""


def _daily(spark, d):
    panel = P.segment_day(spark, d)
    spine = panel.select("series_id").distinct().crossJoin(F.broadcast(joins.weekdays(panel)))  # a calendar, by series
    return spine.join(panel.select("series_id", "ts", "price"), ["series_id", "ts"], "left")


@query(
    f"WITH {_SPINE} SELECT series_id, ts, round(last_value(price IGNORE NULLS) OVER {S.rows(None)}, {D}) AS filled, round(first_value(price IGNORE NULLS) OVER ({S.W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), {D}) AS backed FROM daily"
)
def forward_fill(spark, d):
    df = cleaning.back_fill(cleaning.forward_fill(_daily(spark, d), "price", "filled"), "price", "backed")
    return rounded(df.select("series_id", "ts", "filled", "backed"))


@query(f"WITH {S.TYPE_DAY} SELECT series_id, ts, {r('ret', 'ret')}, {r('volume', 'volume')} FROM panel WHERE ret IS NOT NULL AND volume IS NOT NULL AND logret IS NOT NULL")
def complete_rows(spark, d):
    return rounded(P.type_day(spark, d).dropna(how="any").select("series_id", "ts", "ret", "volume"))


def stressed(spark, d) -> DataFrame:
    """The market of the daily panel: (series_id, ts, ret, stress)."""
    m = P.type_day(spark, d).groupBy("ts").agg(F.avg("ret").alias("ret")).withColumn("series_id", F.lit("market"))
    return m.withColumn("stress", R.realized_volatility("ret")).select("series_id", "ts", "ret", "stress")


@query(
    f"""WITH {S.TYPE_DAY}, {S.MARKET}, s AS (SELECT ts, round(stress, {D}) AS stress FROM stressed), q AS (SELECT quantile_cont(stress, 0.7) AS q FROM s)
    SELECT ts, {r('stress', 'stress')}, coalesce(CAST(stress >= 400 AS INT), -1) AS high, CAST(coalesce(stress >= 400, false) AS INT) AS high_or_missing,
    CASE WHEN stress < 300 THEN 'low' WHEN stress < 500 THEN 'medium' WHEN stress >= 500 THEN 'high' END AS level FROM s"""
)
def stress_labels(spark, d):
    s = rounded(stressed(spark, d).select("ts", "stress"))
    return s.select(
        "ts", "stress", F.coalesce(cleaning.stress_label("stress", 400), F.lit(-1)).alias("high"), cleaning.stress_label("stress", 400, missing_as_false=True).alias("high_or_missing"), cleaning.level("stress", 300, 500).alias("level")
    )


@query(
    f"""WITH {S.TYPE_DAY}, l AS (SELECT series_id, ts, ret, CAST(volume >= 200 AS INT) AS label FROM panel WHERE ret IS NOT NULL),
    sd AS (SELECT series_id, coalesce(stddev_pop(ret) FILTER (label = 1) < stddev_pop(ret) FILTER (label = 0), false) AS flip FROM l GROUP BY 1)
    SELECT series_id, ts, CASE WHEN flip THEN 1 - label ELSE label END AS label FROM l JOIN sd USING (series_id)"""
)
def high_is_one(spark, d):
    df = P.type_day(spark, d).where("ret is not null").select("series_id", "ts", "ret", (F.col("volume") >= 200).cast("int").alias("label"))
    return cleaning.high_is_one(df).select("series_id", "ts", "label")


_PERIODS = [("all", "1900-01-01", "2999-12-31"), ("early", "1900-01-01", "1998-05-31"), ("late", "1998-06-01", "2999-12-31"), ("middle", "1996-06-01", "1999-05-31")]


@query(
    f"""WITH {S.BRAND_WEEK}, periods(period, a, b) AS (VALUES {", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in _PERIODS)})
    SELECT period, series_id, count(*) AS n, {r('avg(ret)', 'mean')} FROM panel JOIN periods ON ts BETWEEN a AND b GROUP BY 1, 2"""
)
def period_means(spark, d):
    periods = spark.createDataFrame(_PERIODS, "period string, start string, stop string").selectExpr("period", "cast(start as date) as start", "cast(stop as date) as stop")
    return rounded(cleaning.in_periods(P.brand_week(spark, d), periods).groupBy("period", "series_id").agg(F.count("*").alias("n"), F.avg("ret").alias("mean")))


@query(
    f"""WITH {S.TYPE_DAY}, fit AS (SELECT series_id, avg(ret) AS m, stddev_pop(ret) AS s FROM (SELECT *, row_number() OVER ({S.W}) AS rn FROM panel) WHERE rn <= 500 GROUP BY 1)
    SELECT series_id, ts, round(least(greatest((ret - m) / nullif(s, 0), -5), 5), {D}) + 0.0 AS z FROM panel JOIN fit USING (series_id) WHERE ret IS NOT NULL"""
)
def standardize_on_fit(spark, d):
    from driftwell.functions.columns import clipped

    df = cleaning.standardized(P.type_day(spark, d), ["ret"], 500).where("ret is not null")
    return rounded(df.select("series_id", "ts", clipped(F.col("ret"), -5, 5).alias("z")))




@query(f"WITH {S.BRAND_WEEK}, x AS (SELECT series_id, ts, coalesce(exp(sum(logret) OVER {S.rows(None)}), 1.0) AS wealth FROM panel) SELECT series_id, ts, {r('wealth', 'wealth')}, {r(f'wealth / max(wealth) OVER {S.rows(None)} - 1', 'drawdown')} FROM x")
def drawdown(spark, d):
    df = cleaning.wealth(P.brand_week(spark, d))
    return rounded(df.select("series_id", "ts", "wealth", R.drawdown("wealth").alias("drawdown")))


@query(f"WITH {S.TYPE_DAY} SELECT ts, {r('avg(ret)', 'mean')}, {r('stddev_samp(ret)', 'dispersion')}, {r('quantile_cont(ret, 0.5)', 'median')}, count(ret) AS n FROM panel GROUP BY ts")
def cross_section(spark, d):
    return rounded(A.cross_section(P.type_day(spark, d)))


@query(f"WITH {S.BRAND_WEEK} SELECT ts, {r('avg(ret)', 'mean')}, {r('stddev_samp(ret)', 'dispersion')}, {r('quantile_cont(ret, 0.5)', 'median')}, count(ret) AS n FROM panel GROUP BY ts")
def market_return(spark, d):
    return rounded(A.cross_section(P.brand_week(spark, d)))


@query(f"WITH {S.TYPE_DAY} SELECT series_id, ts, {r(S.rolling('avg', 'ret', 20, 10), 'm20')}, {r(S.rolling('stddev_samp', 'ret', 20, 10), 's20')}, {r(S.rolling('avg', 'ret', 252), 'm252')} FROM panel")
def rolling_mean_std(spark, d):
    """On blocks of 1024 rows with a halo, as for series of any length."""
    exprs = lambda p: p.withColumns({"m20": R.rolling_mean("ret", 20, 10), "s20": R.rolling_std("ret", 20, 10), "m252": R.rolling_mean("ret", 252)})
    df = blocks.in_blocks(P.type_day(spark, d).select("series_id", "ts", "ret"), 251, exprs, 1024)
    return rounded(df.select("series_id", "ts", "m20", "s20", "m252"))


@query(f"WITH {S.BRAND_WEEK} SELECT series_id, ts, {', '.join(r(S.rolling('sum', 'ret', n, n // 2), f'mom{n}') for n in (20, 60, 120))} FROM panel")
def momentum(spark, d):
    return rounded(P.brand_week(spark, d).select("series_id", "ts", *(R.momentum("ret", n).alias(f"mom{n}") for n in (20, 60, 120))))


@query(f"WITH {S.TYPE_DAY} SELECT series_id, ts, round(sqrt(252) * 100 * {S.rolling('stddev_samp', 'ret', 21)}, {D}) + 0.0 AS vol FROM panel")
def realized_vol(spark, d):
    return rounded(P.type_day(spark, d).select("series_id", "ts", R.realized_volatility("ret").alias("vol")))


_DOWN, _UP, _UP0 = "CASE WHEN ret < 0 THEN ret END", "CASE WHEN ret > 0 THEN ret END", "CASE WHEN ret >= 0 THEN ret END"


def _asym(sd: str, up: str, least: int, strict: bool, minus: str = "") -> str:
    f = S.rows(19)
    full = f" AND count(*) OVER {f} >= 20" if strict else ""
    return f"CASE WHEN count({_DOWN}) OVER {f} >= {least} AND count({up}) OVER {f} >= {least}{full} THEN {sd}({_DOWN}) OVER {f} / nullif({sd}({up}) OVER {f}, 0) {minus} END"


@query(
    f"WITH {S.TYPE_DAY} SELECT series_id, ts, {r(_asym('stddev_samp', _UP0, 3, True), 'strict')}, {r(_asym('stddev_samp', _UP0, 10, False), 'loose')}, {r(_asym('stddev_pop', _UP, 2, False, '- 1'), 'market')} FROM panel"
)
def vol_asymmetry(spark, d):
    return rounded(P.type_day(spark, d).select("series_id", "ts", *(R.asymmetry("ret", 20, f).alias(f) for f in ("strict", "loose", "market"))))


@query(
    f"WITH {S.TYPE_DAY}, x AS (SELECT *, abs(ret) * 1e6 / nullif(dollar_volume, 0) AS i FROM panel) SELECT series_id, ts, {r(S.rolling('avg', 'i', 20, 10), 'amihud')} FROM x"
)
def amihud(spark, d):
    return rounded(R.amihud(P.type_day(spark, d)).select("series_id", "ts", "amihud"))


@query(f"WITH {S.TYPE_DAY} SELECT series_id, ts, {r(S.expanding_z('ret', 252), 'z')} FROM panel")
def expanding_z(spark, d):
    return rounded(P.type_day(spark, d).select("series_id", "ts", R.expanding_z("ret").alias("z")))


@query(
    f"WITH {S.TYPE_DAY} SELECT series_id, ts, round(CASE WHEN count(ret) OVER {S.rows(251)} >= 60 THEN (ret - avg(ret) OVER {S.rows(251)}) / greatest(stddev_samp(ret) OVER {S.rows(251)}, 1e-8) END, {D}) + 0.0 AS z FROM panel"
)
def rolling_z(spark, d):
    return rounded(P.type_day(spark, d).select("series_id", "ts", R.rolling_z("ret").alias("z")))


def _corr(x: str, y: str, n: int) -> str:
    f = S.rows(n - 1)
    x2, y2 = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"covar_pop({x2}, {y2}) OVER {f} / nullif(stddev_pop({x2}) OVER {f} * stddev_pop({y2}) OVER {f}, 0)"


@query(
    f"WITH {S.TYPE_DAY}, x AS (SELECT *, lag(ret) OVER ({S.W}) AS l, row_number() OVER ({S.W}) AS rn FROM panel) SELECT series_id, ts, round(CASE WHEN rn >= 60 THEN {_corr('ret', 'l', 59)} END, {D}) + 0.0 AS autocorr FROM x"
)
def rolling_autocorr(spark, d):
    return rounded(R.autocorrelation(P.type_day(spark, d), "ret").select("series_id", "ts", "autocorr"))


_VR = f"""vr AS (SELECT *, CASE WHEN count(qs) OVER {S.rows(55)} >= 0 AND count(ret) OVER {S.rows(59)} >= 60 THEN var_samp(qs) OVER {S.rows(55)} / nullif(5 * var_samp(ret) OVER {S.rows(59)}, 0) END AS vr
    FROM (SELECT *, CASE WHEN count(ret) OVER {S.rows(4)} >= 5 THEN sum(ret) OVER {S.rows(4)} END AS qs FROM panel))"""


@query(f"WITH {S.TYPE_DAY}, {_VR} SELECT series_id, ts, {r('vr', 'vr')} FROM vr")
def rolling_vr(spark, d):
    return rounded(R.variance_ratio(P.type_day(spark, d), "ret").select("series_id", "ts", "vr"))


_LAGS = ", ".join(f"lag(ret, {k}) OVER ({S.W}) AS l{k}" for k in range(1, 11))
_LB = f"""lagged AS (SELECT *, {_LAGS} FROM panel), corrs AS (SELECT series_id, ts, ret, count(ret) OVER {S.rows(59)} AS n, {", ".join(f"coalesce({_corr('ret', f'l{k}', 60 - k)}, 0) AS r{k}" for k in range(1, 11))} FROM lagged),
    lb AS (SELECT series_id, ts, CASE WHEN n >= 60 THEN 60 * 62 * ({" + ".join(f"r{k} * r{k} / {60 - k}" for k in range(1, 11))}) END AS q FROM corrs)"""
_P = "exp(-q / 2) * (1 + q / 2 + (q / 2) ** 2 / 2 + (q / 2) ** 3 / 6 + (q / 2) ** 4 / 24)"


@query(f"WITH {S.TYPE_DAY}, {_LB} SELECT series_id, ts, {r('q', 'lb_q')}, {r(_P, 'lb_pval')} FROM lb")
def rolling_ljung_box(spark, d):
    return rounded(R.ljung_box(P.type_day(spark, d), "ret").select("series_id", "ts", "lb_q", "lb_pval"))


@query()
def rolling_hurst(spark, d):
    return rounded(E.rolling_hurst(P.type_day(spark, d)).select("series_id", "ts", "hurst"))


@query()
def series_hurst(spark, d):
    return rounded(E.series_hurst(P.brand_week(spark, d)))


@query()
def efficiency_score(spark, d):
    df = E.efficiency_score(P.type_day(spark, d))
    return rounded(df.select("series_id", "ts", "hurst", "vr", "lb_q", "lb_pval", "hurst_eff", "vr_eff", "lb_eff", "efficiency", "inefficiency", "direction"))


@query(
    f"""WITH {S.TYPE_DAY}, {_VR}, {_LB} SELECT series_id, count(vr) AS n, {r('avg(1 / (1 + abs(vr - 1)))', 'vr_eff')}, {r(f'avg(CASE WHEN q IS NOT NULL THEN least(greatest({_P}, 0), 1) END)', 'lb_eff')}, {r('stddev_samp(vr)', 'vr_std')} FROM vr JOIN lb USING (series_id, ts) GROUP BY 1"""
)
def efficiency_summary(spark, d):
    df = E.native_efficiency(P.type_day(spark, d))
    return rounded(df.groupBy("series_id").agg(F.count("vr").alias("n"), F.avg("vr_eff").alias("vr_eff"), F.avg("lb_eff").alias("lb_eff"), F.stddev_samp("vr").alias("vr_std")))


@query(f"WITH {S.TYPE_DAY} SELECT series_id, ts, round(CASE WHEN count(ret) OVER {S.rows(252, 1)} >= 252 THEN quantile_cont(ret, 0.4) OVER {S.rows(252, 1)} END, {D}) + 0.0 AS tau FROM panel")
def rolling_tau(spark, d):
    return rounded(P.type_day(spark, d).select("series_id", "ts", R.shifted_quantile("ret").alias("tau")))


@query(
    f"""WITH {S.BRAND_WEEK}, x AS (SELECT series_id, ts, round(ret, 9) AS ret FROM panel), y AS (SELECT *, count(ret) OVER {S.rows(None, 1)} AS n, quantile_cont(ret, 0.33) OVER {S.rows(None, 1)} AS a, quantile_cont(ret, 0.67) OVER {S.rows(None, 1)} AS b FROM x)
    SELECT series_id, ts, CASE WHEN ret IS NULL THEN NULL WHEN n < 60 THEN 'medium' WHEN ret <= a THEN 'low' WHEN ret >= b THEN 'high' ELSE 'medium' END AS state FROM y"""
)
def expanding_tercile(spark, d):
    df = P.brand_week(spark, d).withColumn("ret", F.round("ret", 9))
    return R.tercile_states(df.select("series_id", "ts", "ret"), "ret", size=256).select("series_id", "ts", "state")


@query(
    f"""WITH RECURSIVE {S.BRAND_WEEK}, x AS (SELECT series_id, ts, coalesce(ret, 0) AS v, row_number() OVER ({S.W}) AS rn FROM panel),
    e AS (SELECT series_id, ts, rn, v AS y FROM x WHERE rn = 1 UNION ALL SELECT x.series_id, x.ts, x.rn, 0.94 * e.y + 0.06 * x.v FROM x JOIN e ON x.series_id = e.series_id AND x.rn = e.rn + 1)
    SELECT series_id, ts, {r('y', 'ewma')} FROM e"""
)
def ewma(spark, d):
    df = P.brand_week(spark, d).select("series_id", "ts", F.coalesce("ret", F.lit(0.0)).alias("v"))
    return rounded(blocks.ewma(df, "v", "ewma", alpha=0.06, size=128).select("series_id", "ts", "ewma"))


@query(
    f"""WITH {S.BRAND_WEEK}, x AS (SELECT series_id, ts, coalesce(ret, 0) AS v, row_number() OVER ({S.W}) AS rn FROM panel)
    SELECT a.series_id, a.ts, round(sum(b.v * 0.5 ** ((a.rn - b.rn) / 10.0)) / sum(0.5 ** ((a.rn - b.rn) / 10.0)), {D}) + 0.0 AS ewma FROM x a JOIN x b ON a.series_id = b.series_id AND b.rn <= a.rn GROUP BY 1, 2"""
)
def ewma_half_life(spark, d):
    df = P.brand_week(spark, d).select("series_id", "ts", F.coalesce("ret", F.lit(0.0)).alias("v"))
    return rounded(blocks.ewma(df, "v", "ewma", half_life=10, size=128).select("series_id", "ts", "ewma"))


@query(
    f"""WITH {S.TYPE_DAY}, x AS (SELECT *, abs(ret) / nullif({S.rolling('stddev_samp', 'ret', 20, 10)}, 0) AS x FROM panel)
    SELECT series_id, ts, {r(S.rolling('avg', 'x', 20, 10), 'move')}, round(({S.rolling('stddev_samp', 'ret', 20, 10)}) / nullif(({S.rolling('stddev_samp', 'ret', 252, 60)}), 0), {D}) + 0.0 AS vol_ratio, {r(f'ret - lag(ret, 5) OVER ({S.W})', 'diff5')}, {r(f'lead(ret, 5) OVER ({S.W})', 'lead5')} FROM x"""
)
def vol_ratio_and_lags(spark, d):
    df = R.move_to_volatility(P.type_day(spark, d), "ret")
    return rounded(df.select("series_id", "ts", "move", R.volatility_ratio("ret").alias("vol_ratio"), R.difference("ret", 5).alias("diff5"), F.lead("ret", 5).over(cleaning.in_time()).alias("lead5")))


@query(
    f"""WITH {S.TYPE_DAY}, {S.MONTHLY}, late AS (SELECT ts, lag(value) OVER (ORDER BY ts) AS v FROM monthly),
    z AS (SELECT ts, v, CASE WHEN count(v) OVER f >= 12 THEN (v - avg(v) OVER f) / nullif(stddev_samp(v) OVER f, 0) END AS z FROM late WINDOW f AS (ORDER BY ts ROWS UNBOUNDED PRECEDING)),
    days AS (SELECT DISTINCT ts FROM panel), a AS (SELECT d.ts, l.v FROM days d ASOF LEFT JOIN (SELECT * FROM z WHERE v IS NOT NULL) l ON d.ts >= l.ts)
    SELECT a.ts, {r('a.v', 'sentiment')}, {r('b.z', 'sentiment_z')} FROM a ASOF LEFT JOIN (SELECT * FROM z WHERE z IS NOT NULL) b ON a.ts >= b.ts"""
)
def asof_sentiment(spark, d):
    days = P.type_day(spark, d).select("ts").distinct()
    return rounded(B.sentiment(days, P.monthly_order_value(spark, d)).select("ts", "sentiment", "sentiment_z"))


_PROXIES = f"""day AS (SELECT 'market' AS series_id, ts, avg(ret) AS ret, stddev_samp(ret) AS dd, quantile_cont(abs(ret) * 1e6 / nullif(dollar_volume, 0), 0.5) AS ii FROM panel GROUP BY ts),
    withs AS (SELECT *, {S.rolling('stddev_samp', 'ret', 21)} * sqrt(252) * 100 AS stress, CASE WHEN count(ret) OVER {S.rows(4)} >= 5 THEN sum(ret) OVER {S.rows(4)} END AS qs FROM day),
    proxies AS (SELECT series_id, ts, {S.rolling('avg', 'dd', 20, 10)} AS herd, CASE WHEN count(ret) OVER {S.rows(59)} >= 60 THEN abs(var_samp(qs) OVER {S.rows(55)} / nullif(5 * var_samp(ret) OVER {S.rows(59)}, 0) - 1) END AS vr,
        {_asym('stddev_samp', _UP0, 3, True)} AS asym, {S.rolling('avg', 'stress', 5, 2)} AS sent, {S.rolling('avg', 'ii', 20, 10)} AS illiq FROM withs),
    zs AS (SELECT ts, {S.expanding_z('herd', 252)} AS z_herd, {S.expanding_z('vr', 252)} AS z_vr, {S.expanding_z('asym', 252)} AS z_asym, -({S.expanding_z('sent', 252)}) AS z_sent, {S.expanding_z('illiq', 252)} AS z_illiq FROM proxies)"""
_ZS = ("z_herd", "z_vr", "z_asym", "z_sent", "z_illiq")


@query(
    f"WITH {S.TYPE_DAY}, {_PROXIES} SELECT ts, {', '.join(r(z, z) for z in _ZS)}, round(list_avg([x for x in [{', '.join(_ZS)}] if x IS NOT NULL]), {D}) + 0.0 AS bpc FROM zs"
)
def bpc(spark, d):
    return rounded(B.composite(B.market_proxies(P.type_day(spark, d))).select("ts", *_ZS, "bpc"))


def _rolling_z(x: str) -> str:
    f = S.rows(251)
    return f"CASE WHEN count({x}) OVER {f} >= 60 THEN ({x} - avg({x}) OVER {f}) / greatest(stddev_samp({x}) OVER {f}, 1e-8) END"


_SIDE = {side: f"CASE WHEN market {side} 0 THEN market END" for side in "<>"}


@query(
    f"""WITH {S.TYPE_DAY}, {S.MARKET}, disp AS (SELECT ts, -stddev_samp(ret) AS herd FROM panel GROUP BY ts),
    m AS (SELECT series_id, ts, ret AS market, stress, herd, lag(ret) OVER ({S.W}) AS l, row_number() OVER ({S.W}) AS rn FROM stressed JOIN disp USING (ts)),
    x AS (SELECT *, abs(market) / nullif({S.rolling('stddev_samp', 'market', 20, 10)}, 0) AS mv, -({S.rolling('avg', 'stress', 5, 2)}) AS sent FROM m), y AS (SELECT *, {S.rolling('avg', 'mv', 20, 10)} AS move FROM x)
    SELECT ts, {r('market', 'market')}, {r(_rolling_z('herd'), 'herding_z')}, {r(f'CASE WHEN rn >= 60 THEN corr(market, l) OVER {S.rows(58)} END', 'autocorr')},
    {r(f"CASE WHEN count({_SIDE['<']}) OVER {S.rows(19)} >= 2 AND count({_SIDE['>']}) OVER {S.rows(19)} >= 2 THEN stddev_pop({_SIDE['<']}) OVER {S.rows(19)} / nullif(stddev_pop({_SIDE['>']}) OVER {S.rows(19)}, 0) - 1 END", 'vol_asym')},
    {r(f"({S.rolling('stddev_samp', 'market', 20, 10)}) / nullif({S.rolling('stddev_samp', 'market', 252, 60)}, 0)", 'vol_ratio')}, {r(_rolling_z('sent'), 'sentiment')}, {r(_rolling_z('move'), 'illiq_z')} FROM y"""
)
def rolling_composite(spark, d):
    return rounded(B.rolling_composite(P.type_day(spark, d)).drop("series_id"))


@query(
    f"""WITH {S.BRAND_WEEK}, x AS (SELECT *, {S.rolling('sum', 'ret', 60, 30)} AS mom, {_asym('stddev_samp', _UP0, 10, False)} AS asym, abs(ret) * 1e6 / nullif(dollar_volume, 0) AS i FROM panel),
    y AS (SELECT *, {S.rolling('avg', 'i', 20, 10)} AS illiq FROM x), z AS (SELECT series_id, ts, {S.expanding_z('mom', 52)} AS z_mom, {S.expanding_z('asym', 52)} AS z_asym, {S.expanding_z('illiq', 52)} AS z_illiq FROM y)
    SELECT series_id, ts, {r('z_mom', 'z_mom')}, {r('z_asym', 'z_asym')}, {r('z_illiq', 'z_illiq')}, {r('(z_mom + z_asym + z_illiq) / 3', 'score')} FROM z"""
)
def asset_signal(spark, d):
    return rounded(B.asset_signal(P.brand_week(spark, d), least=52).select("series_id", "ts", "z_mom", "z_asym", "z_illiq", "score"))


@query(
    f"""WITH {S.BRAND_WEEK}, x AS (SELECT ts, series_id, round(ret, 9) AS s FROM panel WHERE ret IS NOT NULL), k AS (SELECT *, greatest(1, CAST(floor(count(*) OVER (PARTITION BY ts) * 0.2) AS BIGINT)) AS k,
    row_number() OVER (PARTITION BY ts ORDER BY s DESC, series_id) AS a, row_number() OVER (PARTITION BY ts ORDER BY s, series_id) AS b FROM x)
    SELECT ts, series_id, {r('s', 's')}, CAST(CASE WHEN a <= k THEN a ELSE b END AS INT) AS rank, CASE WHEN a <= k THEN 1 ELSE -1 END AS side FROM k WHERE a <= k OR b <= k"""
)
def topk_basket(spark, d):
    df = P.brand_week(spark, d).select("ts", "series_id", F.round("ret", 9).alias("s"))
    return rounded(A.top_bottom(df, ["ts"], "s"))


@query(
    f"""WITH {S.TYPE_DAY} SELECT series_id, {r('avg(ret)', 'mean')}, {r('stddev_samp(ret)', 'std')}, {r('quantile_cont(ret, 0.5)', 'median')}, {r('quantile_cont(ret, 0.05)', 'p05')}, {r('quantile_cont(ret, 0.95)', 'p95')}, count(ret) AS n,
    {r('avg(CASE WHEN abs(ret) > 1.96 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END)', 'share_large')} FROM panel GROUP BY 1"""
)
def group_quantiles(spark, d):
    return rounded(A.grouped(P.type_day(spark, d), ["series_id"], "ret"))


@query(
    """SELECT p_type AS series_id, count(*) FILTER (p_size % 4 + 1 = 1) AS k_1, count(*) FILTER (p_size % 4 + 1 = 2) AS k_2, count(*) FILTER (p_size % 4 + 1 = 3) AS k_3, count(*) FILTER (p_size % 4 + 1 = 4) AS k_4
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"""
)
def crosstab_k(spark, d):
    items = P.table(spark, d, "lineitem").select("l_partkey").join(P.table(spark, d, "part").select("p_partkey", F.col("p_type").alias("series_id"), (F.col("p_size") % 4 + 1).alias("k")), F.col("l_partkey") == F.col("p_partkey"))
    return A.crosstab(items, "series_id", "k", [1, 2, 3, 4])


@query(f"WITH {S.TYPE_DAY} SELECT name, count(x) AS n, {r('avg(x)', 'mean')}, {r('stddev_samp(x)', 'std')}, {r('min(x)', 'min')}, {r('max(x)', 'max')} FROM (UNPIVOT (SELECT ret, logret, volume FROM panel) ON ret, logret, volume INTO NAME name VALUE x) GROUP BY 1")
def column_summary(spark, d):
    return rounded(A.summary(P.type_day(spark, d), ["ret", "logret", "volume"]))


@query(
    """WITH c AS (SELECT l_shipdate, l_returnflag, l_linenumber FROM lineitem), n AS (SELECT l_returnflag, l_linenumber, count(*) AS n FROM c GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_linenumber) AS i FROM n) SELECT l_returnflag, l_linenumber AS mode, n FROM k WHERE i = 1"""
)
def group_mode(spark, d):
    return A.mode(P.table(spark, d, "lineitem").select("l_returnflag", "l_linenumber"), ["l_returnflag"], "l_linenumber")


@query(f"SELECT event_type, count(*) AS n, {r('count(*) / sum(count(*)) OVER ()', 'share')} FROM events GROUP BY 1")
def value_shares(spark, d):
    return rounded(A.value_shares(P.table(spark, d, "events"), "event_type"))


@query(
    f"WITH {S.TYPE_DAY}, x AS (SELECT series_id, count(*) AS n, covar_pop(ret, volume) / nullif(stddev_pop(ret) * stddev_pop(volume), 0) AS r FROM panel WHERE ret IS NOT NULL AND volume IS NOT NULL GROUP BY 1) SELECT series_id, n, {r('r', 'r')}, {r('CASE WHEN n > 2 AND abs(r) < 1 THEN r * sqrt((n - 2) / (1 - r * r)) END', 't')} FROM x"
)
def correlation(spark, d):
    return rounded(A.correlation(P.type_day(spark, d), "ret", "volume", ["series_id"]))


@query(
    f"""WITH {S.TYPE_DAY}, x AS (SELECT *, volume >= 200 AS s FROM panel), u AS (UNPIVOT x ON ret, dollar_volume INTO NAME name VALUE x)
    SELECT name, {r('avg(x) FILTER (s)', 'inside')}, {r('avg(x) FILTER (NOT s)', 'outside')}, {r('avg(x) FILTER (s) - avg(x) FILTER (NOT s)', 'gap')} FROM u GROUP BY 1"""
)
def conditional_means(spark, d):
    return rounded(A.conditional_means(P.type_day(spark, d), ["ret", "dollar_volume"], F.col("volume") >= 200))


@query(
    f"""WITH {S.TYPE_DAY}, c AS (SELECT series_id, ret, avg(ret) OVER (PARTITION BY series_id) AS m FROM panel WHERE ret IS NOT NULL)
    SELECT series_id, count(*) AS n, {r('avg(ret)', 'mean')}, {r('stddev_samp(ret)', 'std')}, {r('avg((ret - m) ** 3) / avg((ret - m) ** 2) ** 1.5', 'skew')}, {r('avg((ret - m) ** 4) / avg((ret - m) ** 2) ** 2', 'kurtosis')} FROM c GROUP BY 1"""
)
def moments(spark, d):
    return rounded(A.moments(P.type_day(spark, d), ["series_id"], "ret"))


@query(
    f"""WITH {S.SEGMENT_DAY}, t AS (SELECT ts, avg(price) AS value FROM panel WHERE series_id = 'BUILDING' GROUP BY 1), u AS (SELECT ts, avg(price) AS value FROM panel WHERE series_id = 'MACHINERY' GROUP BY 1)
    SELECT coalesce(t.ts, u.ts) AS ts, {r('t.value', 'building')}, {r('u.value', 'machinery')} FROM t FULL JOIN u ON t.ts = u.ts"""
)
def full_alignment(spark, d):
    p = P.segment_day(spark, d)
    one = lambda s: p.where(F.col("series_id") == s).select("ts", F.col("price").alias("value"))
    return rounded(joins.aligned(one("BUILDING"), one("MACHINERY"), names=["building", "machinery"]))


@query(f"WITH {S.TYPE_DAY}, {S.MONTHLY} SELECT p.series_id, p.ts, {r('m.value', 'value')} FROM panel p ASOF LEFT JOIN monthly m ON p.ts >= m.ts")
def asof_join(spark, d):
    p = P.type_day(spark, d).select("series_id", "ts")
    return rounded(joins.as_of(p, P.monthly_order_value(spark, d), "value"))


@query("SELECT c_custkey AS series_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def missing_series(spark, d):
    found = P.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("series_id"))
    return joins.missing(P.table(spark, d, "customer").select(F.col("c_custkey").alias("series_id")), found)


@query(f"WITH {S.SEGMENT_DAY} SELECT CAST(ts AS DATE) AS ts FROM (SELECT unnest(generate_series((SELECT min(ts) FROM panel), (SELECT max(ts) FROM panel), INTERVAL 1 DAY)) AS ts) WHERE isodow(ts) < 6")
def weekday_calendar(spark, d):
    return joins.weekdays(P.segment_day(spark, d))




@query(
    f"""WITH {S.TYPE_DAY}, x AS (SELECT series_id AS component, 1 + stddev_samp(ret) AS xi_obs, 0.5 + avg(CAST(ret > 0 AS INT)) AS xi_stick, 0.5 + avg(CAST(volume > 100 AS INT)) AS xi_coord FROM panel GROUP BY 1),
    h AS (SELECT component, round(12 * xi_stick * xi_coord / xi_obs, 9) AS h FROM x) SELECT component, {r('h', 'half_life')}, {r('ln(2) / h', 'decay')}, CAST(row_number() OVER (ORDER BY h DESC, component) AS INT) AS rank FROM h"""
)
def half_life(spark, d):
    x = P.type_day(spark, d).groupBy(F.col("series_id").alias("component")).agg(
        (1 + F.stddev_samp("ret")).alias("xi_obs"), (0.5 + F.avg((F.col("ret") > 0).cast("int"))).alias("xi_stick"), (0.5 + F.avg((F.col("volume") > 100).cast("int"))).alias("xi_coord")
    )
    return rounded(A.half_life(x, 12.0).select("component", "half_life", "decay", "rank"))


@query(
    f"""WITH {S.BRAND_WEEK}, x AS (SELECT series_id, avg(ret) FILTER (ts < DATE '1998-06-01') / nullif(stddev_samp(ret) FILTER (ts < DATE '1998-06-01'), 0) AS o, avg(ret) FILTER (ts >= DATE '1998-06-01') / nullif(stddev_samp(ret) FILTER (ts >= DATE '1998-06-01'), 0) AS r FROM panel GROUP BY 1),
    y AS (SELECT series_id, CASE WHEN r / nullif(o, 0) > 0 THEN -ln(r / o) / 3.0 END AS rate FROM x)
    SELECT series_id, {r('rate', 'rate')}, {r('CASE WHEN rate > 0 THEN ln(2) / rate * 12 END', 'half_life_months')}, {r('0.4 * (1 - 0.5 * (1 - exp(-rate * 12)))', 'tau')} FROM y"""
)
def empirical_decay(spark, d):
    early, late = F.col("ts") < F.lit("1998-06-01").cast("date"), F.col("ts") >= F.lit("1998-06-01").cast("date")
    s = lambda c: F.try_divide(F.avg(F.when(c, F.col("ret"))), F.stddev_samp(F.when(c, F.col("ret"))))
    x = P.brand_week(spark, d).groupBy("series_id").agg(s(early).alias("sr_original"), s(late).alias("sr_replicated")).withColumn("years", F.lit(3.0))
    df = A.empirical_decay(x)
    return rounded(df.select("series_id", "rate", "half_life_months", A.decayed_threshold(0.4, 0.5, F.col("rate"), F.lit(12.0)).alias("tau")))


@query(f"WITH {S.TYPE_DAY} SELECT to_json({{'series_id': series_id, 'n': count(*)}}) AS summary FROM panel GROUP BY series_id")
def json_summary(spark, d):
    return P.json_summary(P.type_day(spark, d).groupBy("series_id").agg(F.count("*").alias("n")))


