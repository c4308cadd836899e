"""Behavioural composites: of the market, with expanding or rolling z-scores, and of each asset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.operators import rolling as R
from driftwell.operators.cleaning import in_time
from driftwell.operators.joins import as_of

PARTS = ("z_herd", "z_vr", "z_asym", "z_sent", "z_illiq")


def market_proxies(panel: DataFrame, stress: DataFrame | None = None, n: int = 20, vr_rows: int = 60) -> DataFrame:
    """(series_id = universe, ts, market, herd, vr, asym, sent, illiq) of each date.

    herd: mean dispersion of the last n dates. vr: variance ratio of the market return. asym: downside over upside deviation.
    sent: five-date mean of ``stress`` (ts, stress), 21-row realised volatility of the market if it is not given. illiq: mean of the
    cross-section median of |return| per traded value.
    """
    traded = panel.withColumn("_i", F.try_divide(F.abs("ret") * 1e6, F.col("dollar_volume")))
    m = traded.groupBy("ts").agg(F.avg("ret").alias("market"), F.stddev_samp("ret").alias("_d"), F.percentile("_i", F.lit(0.5)).alias("_i"))
    m = m.withColumn("series_id", F.lit("market"))
    if stress is not None:
        m = m.join(stress.select("ts", "stress"), "ts", "left")
    else:
        m = m.withColumn("stress", R.realized_volatility("market"))
    m = R.variance_ratio(m, "market", vr_rows, out="vr")
    return m.select(
        "series_id", "ts", "market", "stress", R.rolling_mean("_d", n, n // 2).alias("herd"), "vr", R.asymmetry("market", n, "strict").alias("asym"),
        R.rolling_mean("stress", 5, 2).alias("sent"), R.rolling_mean("_i", n, n // 2).alias("illiq"),
    )


def composite(proxies: DataFrame, least: int = 252) -> DataFrame:
    """Expanding z-scores of the proxies, of |vr - 1| and with sentiment's sign turned, and bpc, the mean of those that are there."""
    df = proxies.withColumn("vr_gap", F.abs(F.col("vr") - 1))
    columns = {"z_herd": "herd", "z_vr": "vr_gap", "z_asym": "asym", "z_sent": "sent", "z_illiq": "illiq"}
    df = df.withColumns({z: (-1 if z == "z_sent" else 1) * R.expanding_z(c, least) for z, c in columns.items()}).drop("vr_gap")
    there = sum((F.col(z).isNotNull().cast("int") for z in PARTS), F.lit(0))
    total = sum((F.coalesce(F.col(z), F.lit(0.0)) for z in PARTS), F.lit(0.0))
    return df.withColumn("bpc", F.when(there > 0, total / there))


def rolling_composite(panel: DataFrame, n: int = 252, least: int = 60) -> DataFrame:
    """The variant with rolling z-scores: herding_z, autocorr, vol_asym, vol_ratio, sentiment (z of minus five-row stress) of the market."""
    m = panel.groupBy("ts").agg(F.avg("ret").alias("market"), F.stddev_samp("ret").alias("_d")).withColumn("series_id", F.lit("market"))
    m = m.withColumns({"stress": R.realized_volatility("market"), "herd": -F.col("_d")})
    m = R.move_to_volatility(R.autocorrelation(m, "market", 60), "market")
    m = m.withColumn("_s", -R.rolling_mean("stress", 5, 2))
    return m.select(
        "series_id", "ts", "market", R.rolling_z("herd", n, least).alias("herding_z"), "autocorr", R.asymmetry("market", 20, "market").alias("vol_asym"),
        R.volatility_ratio("market").alias("vol_ratio"), R.rolling_z("_s", n, least).alias("sentiment"), R.rolling_z("move", n, least).alias("illiq_z"),
    )


def asset_signal(panel: DataFrame, mom: int = 60, n: int = 20, least: int = 252) -> DataFrame:
    """z-scores of momentum, asymmetry and illiquidity of each asset, and their mean; null if any is."""
    df = panel.withColumns({"mom": R.momentum("ret", mom), "asym": R.asymmetry("ret", n, "loose")})
    df = R.amihud(df, n=n, least=n // 2, out="illiq")
    df = df.withColumns({"z_mom": R.expanding_z("mom", least), "z_asym": R.expanding_z("asym", least), "z_illiq": R.expanding_z("illiq", least)})
    return df.withColumn("score", (F.col("z_mom") + F.col("z_asym") + F.col("z_illiq")) / 3)


def sentiment(days: DataFrame, monthly: DataFrame, value: str = "value", least: int = 12) -> DataFrame:
    """A monthly series (ts, value), one month late, as of each day, and its expanding z-score over months."""
    m = monthly.withColumn("series_id", F.lit("sentiment")).withColumn("late", F.lag(value).over(in_time()))
    m = m.withColumn("z", R.expanding_z("late", least))
    return as_of(as_of(days, m.select("ts", "late"), "late", "sentiment"), m.select("ts", "z"), "z", "sentiment_z")
