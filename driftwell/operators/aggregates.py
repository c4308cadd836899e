"""Cross-section and group aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftwell.functions.columns import ratio
from driftwell.operators.rolling import safe_corr


def cross_section(panel: DataFrame, column: str = "ret") -> DataFrame:
    """(ts, mean, dispersion, median, n) over series of each date, nulls skipped."""
    return panel.groupBy("ts").agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("dispersion"), F.percentile(column, F.lit(0.5)).alias("median"), F.count(column).alias("n"))


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, mean, std, min, max) of columns: one pass."""
    stacked = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns))).alias("v"))
    return stacked.groupBy(F.col("v.name").alias("name")).agg(F.count("v.x").alias("n"), F.avg("v.x").alias("mean"), F.stddev_samp("v.x").alias("std"), F.min("v.x").alias("min"), F.max("v.x").alias("max"))


def grouped(df: DataFrame, by: list[str], column: str, large: float = 1.96) -> DataFrame:
    """mean, std, median, p05, p95, n and the share with |x| over ``large``, by group."""
    x = F.col(column)
    return df.groupBy(*by).agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.percentile(x, F.lit(0.5)).alias("median"), F.percentile(x, F.lit(0.05)).alias("p05"),
        F.percentile(x, F.lit(0.95)).alias("p95"), F.count(x).alias("n"), F.avg((F.abs(x) > large).cast("double")).alias("share_large"),
    )


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts by row and one column (k_value) for each of fixed values."""
    counts = df.groupBy(row).pivot(column, values).count().fillna(0)
    return counts.select(row, *(F.col(str(v)).cast("long").alias(f"k_{v}") for v in values))


def mode(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """The commonest value of each group, the smallest of equals, and its count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(column).alias("v"))).alias("b"))
    return best.select(*by, F.col("b.v").alias("mode"), (-F.col("b.m")).alias("n"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def correlation(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, n, r, t) of Pearson's correlation; t has n - 2 degrees of freedom."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    g = df.groupBy(*by).agg(F.count(F.when(both, 1)).alias("n"), safe_corr(F.col(x), F.col(y)).alias("r"))
    return g.withColumn("t", F.when((F.col("n") > 2) & (F.abs("r") < 1), F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))))


def conditional_means(df: DataFrame, columns: list[str], state: Column) -> DataFrame:
    """(name, inside, outside, gap): means of columns where ``state`` holds and where it does not."""
    df = df.withColumn("_s", state)
    stacked = df.select("_s", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns))).alias("v"))
    g = stacked.groupBy(F.col("v.name").alias("name")).agg(F.avg(F.when(F.col("_s"), F.col("v.x"))).alias("inside"), F.avg(F.when(~F.col("_s"), F.col("v.x"))).alias("outside"))
    return g.withColumn("gap", F.col("inside") - F.col("outside"))


def moments(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, n, mean, std, skew, kurtosis): biased skewness and raw kurtosis, 3 for a normal."""
    return df.groupBy(*by).agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.skewness(column).alias("skew"), (F.kurtosis(column) + 3).alias("kurtosis")
    )


def top_bottom(df: DataFrame, by: list[str], signal: str, share: float = 0.2) -> DataFrame:
    """(by, series_id, signal, rank, side): the max(1, int(n * share)) series of the largest and smallest signal; equals by series id."""
    df = df.where(F.col(signal).isNotNull())
    w = W.partitionBy(*by)
    k = F.greatest(F.lit(1), F.floor(F.count("*").over(w) * share))
    df = df.withColumns({"_k": k, "_top": F.row_number().over(w.orderBy(F.desc(signal), "series_id")), "_low": F.row_number().over(w.orderBy(signal, "series_id"))})
    side = F.when(F.col("_top") <= F.col("_k"), 1).when(F.col("_low") <= F.col("_k"), -1)
    rank = F.when(side == 1, F.col("_top")).otherwise(F.col("_low"))
    return df.select(*by, "series_id", signal, rank.alias("rank"), side.alias("side")).where("side is not null")


def best(df: DataFrame, by: list[str], value: str, keys: list[str], largest: bool = True) -> DataFrame:
    """The row of the largest (or smallest) value of each group; the least keys of equals."""
    df = df.where(F.col(value).isNotNull())
    v = -F.col(value) if largest else F.col(value)
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.min(F.struct(v.alias("v"), *keys)).alias("b")).select(*by, *(F.col(f"b.{k}") for k in keys), (-F.col("b.v") if largest else F.col("b.v")).alias(value))


def half_life(df: DataFrame, base_months: float) -> DataFrame:
    """Half-life of a signal, base * stick * coord / obs, its decay rate and its rank (1: slowest)."""
    df = df.withColumn("half_life", ratio(base_months * F.col("xi_stick") * F.col("xi_coord"), F.col("xi_obs")))
    df = df.withColumn("decay", ratio(F.log(F.lit(2.0)), F.col("half_life")))
    return df.withColumn("rank", F.row_number().over(W.partitionBy().orderBy(F.desc("half_life"), "component")))


def empirical_decay(df: DataFrame) -> DataFrame:
    """-ln(replicated / original) / years, and the half-life in months; null unless the ratio and the rate are positive."""
    r = ratio("sr_replicated", "sr_original")
    df = df.withColumn("rate", F.when(r > 0, ratio(-F.log(r), F.col("years"))))
    return df.withColumn("half_life_months", F.when(F.col("rate") > 0, F.log(F.lit(2.0)) / F.col("rate") * 12))


def decayed_threshold(tau: float, share: float, rate: Column, months: Column) -> Column:
    """tau * (1 - share * (1 - exp(-rate * months)))."""
    return tau * (1 - share * (1 - F.exp(-rate * months)))
