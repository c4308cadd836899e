"""Queries of whole universes: panels loaded from files, chains over several universes, and tables of detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwell.operators import cleaning, joins
from driftwell.operators import inference as I
from driftwell.operators import rolling as R
from driftwell.operators.regimes import hmm
from driftwell.plans import fixtures as S
from driftwell.plans import regime_queries
from driftwell.plans.panel_queries import last_dates, r, rounded, stressed
from driftwell.plans.stat_queries import DRAWN
from driftwell.sources import panel as P
from driftwell.sources.shared import new_folder
from driftwell.sources.stages import resumed
from driftwell.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
DATES: dict[str, tuple[str, ...]] = {}


def query(sql: str, dates: tuple[str, ...] | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        DATES[f.__name__] = dates if dates is not None else last_dates(sql)
        return f

    return add


_ORDERS = """orders_day AS (SELECT c_mktsegment AS series_id, CAST(o_orderdate AS DATE) AS ts, round(avg(o_totalprice), 4) AS price, CAST(count(*) AS DOUBLE) AS volume FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    spine AS (SELECT series_id, ts FROM (SELECT DISTINCT series_id FROM orders_day), (SELECT DISTINCT ts FROM orders_day WHERE ts <= DATE '1997-12-31'))"""


@query(
    f"""WITH {_ORDERS} SELECT series_id, ts, {r('price', 'price')}, {r('volume', 'volume')}, {r('price * volume', 'dollar_volume')}, {r(f'price / lag(price) OVER ({S.W}) - 1', 'ret')} FROM spine LEFT JOIN orders_day USING (series_id, ts)"""
)
def loaded_universe(spark, d):
    """Prices and volumes written as CSV files with a column a series, read again up to a last day, joined, and kept as a snapshot that a second call finds."""
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = orders.groupBy(F.col("c_mktsegment").alias("series_id"), F.to_date("o_orderdate").alias("Date")).agg(F.round(F.avg("o_totalprice"), 4).alias("price"), F.count("*").cast("double").alias("volume"))
    names = sorted(x["series_id"] for x in day.select("series_id").distinct().collect())  # columns of the files
    at = new_folder(spark, "universe")
    for value in ("price", "volume"):
        day.groupBy("Date").pivot("series_id", names).agg(F.first(value)).write.csv(f"{at}/{value}", header=True)
    load = lambda value: P.wide_csv(spark, f"{at}/{value}", names, "1997-12-31", value=value)
    build = lambda: P.universe(load("price"), load("volume"))
    P.snapshot(spark, f"{at}/snapshot", build)
    return rounded(P.snapshot(spark, f"{at}/snapshot", build).select("series_id", "ts", "price", "volume", "dollar_volume", "ret"))


@query(
    " UNION ALL ".join(
        f"""SELECT '{name}' AS universe, * FROM (WITH {panel}, s AS (SELECT series_id, count(ret) AS n, avg(ret) AS m, stddev_samp(ret) AS s FROM panel GROUP BY 1), x AS (SELECT p.*, p.ret - m AS e FROM panel p JOIN s USING (series_id) WHERE ret IS NOT NULL),
    g AS (SELECT series_id, sum(e * l) / nullif(sum(e * e), 0) AS rho FROM (SELECT *, lag(e) OVER ({S.W}) AS l FROM x) GROUP BY 1)
    SELECT count(*) AS n_series, CAST(sum(n) AS BIGINT) AS n_returns, {r('quantile_cont(s * sqrt(252), 0.5)', 'median_vol')}, {r('quantile_cont(rho, 0.5)', 'median_rho')}, {r('avg(CAST(rho * sqrt(n) < -1.96 AS INT))', 'reverting')} FROM s JOIN g USING (series_id) WHERE n > 30)"""
        for name, panel in (("brand_week", S.BRAND_WEEK), ("type_day", S.TYPE_DAY))
    ),
    dates=(),
)
def universe_table(spark, d):
    """The same chain over two universes, keyed by universe: series, returns, volatility, first autocorrelation, and the share of series that revert."""
    keep = ("series_id", "ts", "ret")
    both = P.brand_week(spark, d).select(F.lit("brand_week").alias("universe"), *keep).unionByName(P.type_day(spark, d).select(F.lit("type_day").alias("universe"), *keep)).where("ret is not null")
    by = ["universe", "series_id"]
    stats = both.groupBy(*by).agg(F.count("ret").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    e = both.join(stats, by).withColumn("e", F.col("ret") - F.col("m"))
    e = e.withColumn("l", F.lag("e").over(W.partitionBy(*by).orderBy("ts")))
    rho = e.groupBy(*by).agg(F.try_divide(F.sum(F.col("e") * F.col("l")), F.sum(F.col("e") * F.col("e"))).alias("rho"))
    g = stats.join(rho, by).where("n > 30").groupBy("universe")
    return rounded(
        g.agg(
            F.count("*").alias("n_series"), F.sum("n").alias("n_returns"), F.percentile(F.col("s") * F.sqrt(F.lit(252.0)), F.lit(0.5)).alias("median_vol"), F.percentile("rho", F.lit(0.5)).alias("median_rho"),
            F.avg((F.col("rho") * F.sqrt("n") < -1.96).cast("int")).alias("reverting"),
        )
    )


_LABELS = f"""{S.TYPE_DAY}, {S.MARKET}, w AS (SELECT ts, ret, round(stress, 6) AS stress, round(sum(ret) OVER (ORDER BY ts ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), 6) AS month, round(exp(sum(coalesce(ln(1 + greatest(ret, -0.999999)), 0)) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)), 6) AS wealth FROM stressed),
    l AS (SELECT ts, unnest([{{'label': 'volatility', 'y': CAST(stress >= 400 AS INT)}}, {{'label': 'fall', 'y': CAST(round(ret, 6) < 0 AS INT)}}, {{'label': 'month', 'y': CAST(month < 0 AS INT)}}, {{'label': 'drawdown', 'y': CAST(round(wealth / max(wealth) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1, 6) <= -0.5 AS INT)}}], recursive := true) FROM w),
    s AS (SELECT series_id, ts, unnest([{{'score': 'size', 'v': round(abs(ret), 9)}}, {{'score': 'loss', 'v': round(-ret, 9)}}, {{'score': 'volatility', 'v': round({S.rolling('stddev_samp', 'ret', 20, 10)}, 9)}}], recursive := true) FROM panel)"""


@query(
    f"""WITH {_LABELS}, a AS (SELECT series_id, label, score, v, y FROM s JOIN l USING (ts) WHERE v IS NOT NULL AND y IS NOT NULL), g AS (SELECT series_id, label, score, v, sum(y) AS p, sum(1 - y) AS q FROM a GROUP BY 1, 2, 3, 4),
    c AS (SELECT series_id, label, score, p, q, p * (coalesce(sum(q) OVER (PARTITION BY series_id, label, score ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS w FROM g)
    SELECT series_id, label, score, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg, {r('sum(w) / nullif(sum(p) * sum(q), 0)', 'auc')} FROM c GROUP BY 1, 2, 3""",
    dates=(),
)
def detection_table(spark, d):
    """AUC of three scores of each series against four labels of the market."""
    return rounded(I.auc(_detections(spark, d), "v", "y", ["series_id", "label", "score"]))


@query(
    f"""WITH {_LABELS}, m AS (SELECT label || '/' || score AS series_id, ts, round(avg(v), 9) AS v, max(y) AS y FROM s JOIN l USING (ts) WHERE v IS NOT NULL AND y IS NOT NULL GROUP BY label, score, ts), x AS (SELECT * FROM m), {DRAWN},
    every AS (SELECT series_id, -1 AS rep, v, y FROM k WHERE n >= 50 UNION ALL SELECT series_id, rep, v, y FROM drawn), g AS (SELECT series_id, rep, v, sum(y) AS p, sum(1 - y) AS q FROM every GROUP BY 1, 2, 3),
    c AS (SELECT series_id, rep, p, q, p * (coalesce(sum(q) OVER (PARTITION BY series_id, rep ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS w FROM g),
    z AS (SELECT series_id, rep, sum(w) / nullif(sum(p) * sum(q), 0) AS auc FROM c GROUP BY 1, 2)
    SELECT series_id AS detector, {r('max(auc) FILTER (rep = -1)', 'auc')}, {r('quantile_cont(auc, 0.025) FILTER (rep >= 0)', 'low')}, {r('quantile_cont(auc, 0.975) FILTER (rep >= 0)', 'high')} FROM z GROUP BY 1""",
    dates=(),
)
def detection_intervals(spark, d):
    """AUC of the three scores, averaged over series, against the four labels, with intervals by circular blocks of 21 dates."""
    df = _detections(spark, d).where("y is not null").groupBy("label", "score", "ts").agg(F.round(F.avg("v"), 9).alias("v"), F.max("y").alias("y"))
    df = df.select(F.concat_ws("/", "label", "score").alias("detector"), "ts", "v", "y")
    return rounded(I.auc_bootstrap(df, "v", "y", ["detector"], 100).select("detector", F.col("value").alias("auc"), "low", "high"))


def _detections(spark, d) -> DataFrame:
    order = W.partitionBy("series_id").orderBy("ts")  # the market: one row a date
    m = stressed(spark, d).withColumn("month", F.round(F.sum("ret").over(order.rowsBetween(-20, 0)), 6))
    m = m.withColumn("wealth", F.round(F.exp(F.sum(F.coalesce(F.log1p(F.greatest("ret", F.lit(-0.999999))), F.lit(0.0))).over(order.rowsBetween(W.unboundedPreceding, 0))), 6))
    down = F.round(F.col("wealth") / F.max("wealth").over(order.rowsBetween(W.unboundedPreceding, 0)) - 1, 6) <= -0.5
    kinds = {"volatility": F.round("stress", 6) >= 400, "fall": F.round("ret", 6) < 0, "month": F.col("month") < 0, "drawdown": down}
    labels = m.withColumns({f"y_{k}": v.cast("int") for k, v in kinds.items()}).unpivot(["ts"], [f"y_{k}" for k in kinds], "label", "y").withColumn("label", F.substring("label", 3, 20)).where("y is not null")
    df = P.type_day(spark, d).select("series_id", "ts", F.round(F.abs("ret"), 9).alias("size"), F.round(-F.col("ret"), 9).alias("loss"), F.round(R.rolling_std("ret", 20, 10), 9).alias("volatility"))
    scores = df.unpivot(["series_id", "ts"], ["size", "loss", "volatility"], "score", "v").where("v is not null")
    return joins.on_dates(scores, labels)


@query(f"WITH {_LABELS}, a AS (SELECT s.series_id, label, score, count(*) AS n FROM s JOIN l USING (ts) WHERE v IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3) SELECT label, score, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_series FROM a GROUP BY 1, 2", dates=())
def detection_counts(spark, d):
    """Rows and series behind each cell of the detection table."""
    df = _detections(spark, d)
    return df.groupBy("label", "score", "series_id").agg(F.count("*").alias("n")).groupBy("label", "score").agg(F.sum("n").alias("n"), F.count("*").alias("n_series"))


@query(f"SELECT series_id, ts, CAST(p_high > 0.5 AS INT) AS state FROM ({regime_queries.SQL['hmm_filter']})", dates=("ts",))
def likeliest_state(spark, d):
    """The likelier of two states at each week, from filtered probabilities under given parameters; of equal ones the first."""
    df = regime_queries.weekly(spark, d)
    p = hmm.block_filter(df, regime_queries._given(df), size=64).withColumn("p", F.round("p_high", 6))
    return p.select("series_id", "ts", cleaning.likeliest(F.array(1 - F.col("p"), F.col("p"))).alias("state"))


@query(
    f"""WITH {S.TYPE_DAY}, c AS (SELECT unnest([{{'feature': 'price', 's': stddev_pop(price)}}, {{'feature': 'volume', 's': stddev_pop(volume)}}, {{'feature': 'ret', 's': stddev_pop(ret)}}, {{'feature': 'same', 's': 0}}], recursive := true) FROM panel) SELECT feature FROM c WHERE s > 1e-8""",
    dates=(),
)
def varying_features(spark, d):
    """Columns that are not constant, of four."""
    df = P.type_day(spark, d).withColumn("same", F.lit(1.0))
    return spark.createDataFrame([(c,) for c in cleaning.varying(df, ["price", "volume", "ret", "same"])], "feature string")


@query(
    f"""WITH {S.TYPE_DAY}, y AS (SELECT series_id, CAST(year(ts) AS INT) AS y, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS deviation FROM panel GROUP BY 1, 2)
    SELECT y, count(*) AS series, CAST(sum(n) AS BIGINT) AS n, {r('avg(mean / nullif(deviation, 0))', 'sharpe')}, {r('max(deviation)', 'widest')} FROM y WHERE n >= 5 GROUP BY 1"""
)
def staged_years(spark, d):
    """Three stages that a later run takes up where this one stopped: a panel, its years by series, and the years."""
    years = lambda spark, df: df.groupBy("series_id", F.year("ts").alias("y")).agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("deviation"))
    summary = lambda spark, df, least: df.where(F.col("n") >= least).groupBy("y").agg(F.count("*").alias("series"), F.sum("n").alias("n"), F.avg(F.try_divide("mean", "deviation")).alias("sharpe"), F.max("deviation").alias("widest"))
    stages = [("panel", lambda spark, df: P.type_day(spark, d), {}), ("years", years, {}), ("summary", summary, {"least": 5})]
    return rounded(resumed(spark, new_folder(spark, "stages"), stages, [f"{d}/lineitem.parquet", f"{d}/part.parquet"]))
