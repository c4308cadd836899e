"""Projections, filters and cleaning of long panels. A frame is one series in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from driftwell.functions.columns import ratio

#: Price ratios that a share split leaves behind.
SPLITS = (1 / 4, 1 / 3, 1 / 2, 2 / 3, 3 / 2, 2.0, 3.0, 4.0)


def in_time() -> WindowSpec:
    """The window of a series in time order."""
    return W.partitionBy("series_id").orderBy("ts")


def simple_return(df: DataFrame, price: str = "price", out: str = "ret") -> DataFrame:
    return df.withColumn(out, ratio(price, F.lag(price).over(in_time())) - 1)


def log_return(df: DataFrame, price: str = "price", out: str = "logret", scale: float = 1.0) -> DataFrame:
    """Natural logarithms; null where a price is not positive."""
    log = lambda c: F.when(c > 0, F.log(c))
    return df.withColumn(out, (log(F.col(price)) - log(F.lag(price).over(in_time()))) * scale)


def split_mask(df: DataFrame, ret: str = "ret", out: str = "ret", jump: float = 0.40, tolerance: float = 0.02) -> DataFrame:
    """Nulls returns beyond ``jump`` that look like an unadjusted split."""
    near = F.exists(F.array(*map(F.lit, SPLITS)), lambda x: F.abs((1 + F.col(ret)) / x - 1) < tolerance)
    return df.withColumn(out, F.when(~((F.abs(F.col(ret)) > jump) & near), F.col(ret)))


def covered(df: DataFrame, share: float = 0.8, column: str = "price") -> DataFrame:
    """Rows of the series that have a value on ``share`` of all dates at least. Dates and series are counted in one pass each."""
    dates = df.agg(F.count_distinct("ts").alias("n_dates"))
    kept = df.groupBy("series_id").agg(F.count(column).alias("n")).join(F.broadcast(dates)).where(F.col("n") >= share * F.col("n_dates"))  # one row
    return df.join(kept.select("series_id"), "series_id", "left_semi")


def forward_fill(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or column, F.last(column, ignorenulls=True).over(in_time().rowsBetween(W.unboundedPreceding, 0)))


def back_fill(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or column, F.first(column, ignorenulls=True).over(in_time().rowsBetween(0, W.unboundedFollowing)))


def stress_label(column: str, threshold: float, above: bool = True, missing_as_false: bool = False) -> Column:
    """1 where the column reaches the threshold, else 0; missing is null, or 0 if asked for."""
    x = F.col(column) >= threshold if above else F.col(column) <= threshold
    return (F.coalesce(x, F.lit(False)) if missing_as_false else x).cast("int")


def level(column: str, low: float = 15.0, high: float = 25.0) -> Column:
    """low, medium or high; a bucket holds its left end."""
    return F.when(F.col(column) < low, "low").when(F.col(column) < high, "medium").when(F.col(column) >= high, "high")


def high_is_one(df: DataFrame, label: str = "label", ret: str = "ret") -> DataFrame:
    """Flips a series' 0/1 label where state 1 has the smaller standard deviation."""
    sd = df.groupBy("series_id").agg(*(F.stddev_pop(F.when(F.col(label) == k, F.col(ret))).alias(f"_sd{k}") for k in (0, 1)))
    flip = F.coalesce(F.col("_sd1") < F.col("_sd0"), F.lit(False))
    return df.join(sd, "series_id").withColumn(label, F.when(flip, 1 - F.col(label)).otherwise(F.col(label))).drop("_sd0", "_sd1")


def likeliest(probabilities: str | Column) -> Column:
    """The state of the largest of an array of probabilities, the first of equals, from 0."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def in_periods(df: DataFrame, periods: DataFrame) -> DataFrame:
    """Each row once for each period (period, start, stop) that holds its date; periods may overlap. A table of named periods is small by nature, and checked to be."""
    if periods.limit(1001).count() > 1000:
        return df.join(periods, (F.col("ts") >= F.col("start")) & (F.col("ts") <= F.col("stop")))
    return df.join(F.broadcast(periods), (F.col("ts") >= F.col("start")) & (F.col("ts") <= F.col("stop")))


def varying(df: DataFrame, columns: list[str], least: float = 1e-8) -> list[str]:
    """Those columns whose standard deviation is over ``least``: one aggregate for all."""
    row = df.agg(*(F.stddev_pop(c).alias(c) for c in columns)).first()
    return [c for c in columns if row[c] is not None and row[c] > least]


def standardized(df: DataFrame, columns: list[str], n_fit: int) -> DataFrame:
    """Columns less mean and over deviation of a series' first ``n_fit`` rows."""
    fit = df.withColumn("_rn", F.row_number().over(in_time())).where(F.col("_rn") <= n_fit)
    aggs = [f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    out = df.join(fit.groupBy("series_id").agg(*aggs), "series_id")
    return out.withColumns({c: ratio(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns}).drop(*(f"_{k}_{c}" for c in columns for k in "ms"))


def wealth(df: DataFrame, ret: str = "ret", out: str = "wealth") -> DataFrame:
    """Compounded returns; a null return is 0, one of -1 or less ends the series at 0."""
    r = F.coalesce(F.col(ret), F.lit(0.0))
    frame = in_time().rowsBetween(W.unboundedPreceding, 0)
    alive = F.min(r).over(frame) > -1
    return df.withColumn(out, F.when(alive, F.exp(F.sum(F.when(r > -1, F.log1p(r))).over(frame))).otherwise(0.0))
