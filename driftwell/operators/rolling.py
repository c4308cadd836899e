"""Windowed operators on panels. Every bounded frame counts rows; a value needs its minimum of non-null rows in the frame.

A window is partitioned by series. Where single series are long, ``blocks.in_blocks`` runs the same operators on blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from driftwell.functions.columns import chi2_sf, ratio
from driftwell.operators.blocks import earlier_quantiles
from driftwell.operators.cleaning import in_time

YEAR = 252


def last_rows(n: int, skip: int = 0) -> WindowSpec:
    """The frame of the last ``n`` rows, the current one included, or of ``n`` rows that end ``skip`` rows before."""
    return in_time().rowsBetween(-(n - 1) - skip, -skip)


def guarded(value: Column, column: Column | str, frame: WindowSpec, least: int) -> Column:
    """``value`` where the frame has ``least`` non-null values of ``column``."""
    return F.when(F.count(column).over(frame) >= least, value)


def rolling(agg, column: str, n: int, least: int | None = None) -> Column:
    frame = last_rows(n)
    return guarded(agg(column).over(frame), column, frame, n if least is None else least)


def rolling_mean(column: str, n: int, least: int | None = None) -> Column:
    return rolling(F.avg, column, n, least)


def rolling_std(column: str, n: int, least: int | None = None) -> Column:
    return rolling(F.stddev_samp, column, n, least)


def rolling_sharpe(column: str, n: int, least: int | None = None) -> Column:
    """Annualised; null where the rows of the window are all alike."""
    mean, deviation = rolling(F.avg, column, n, least), rolling_std(column, n, least)
    return F.when(deviation > 0, mean / deviation * math.sqrt(YEAR))


def momentum(column: str, n: int) -> Column:
    """The sum of the last ``n`` rows, if half of them have a value."""
    return rolling(F.sum, column, n, n // 2)


def realized_volatility(column: str, n: int = 21) -> Column:
    """Annualised, in percent."""
    return rolling_std(column, n) * math.sqrt(YEAR) * 100


def asymmetry(column: str, n: int = 20, form: str = "strict") -> Column:
    """Downside over upside deviation in the last n rows.

    strict: a full frame with over two observations on either side (upside counts zeros). loose: n / 2 observations on either
    side. market: population deviations of strictly negative and positive rows, less 1.
    """
    frame, r = last_rows(n), F.col(column)
    down, up = F.when(r < 0, r), F.when(r > 0, r) if form == "market" else F.when(r >= 0, r)
    sd = F.stddev_pop if form == "market" else F.stddev_samp
    least = {"strict": 3, "loose": n // 2, "market": 2}[form]
    enough = (F.count(down).over(frame) >= least) & (F.count(up).over(frame) >= least)
    if form == "strict":
        enough = enough & (F.count(F.lit(1)).over(frame) >= n)
    value = ratio(sd(down).over(frame), sd(up).over(frame))
    return F.when(enough, value - 1 if form == "market" else value)


def expanding_z(column: str, least: int = YEAR) -> Column:
    """How many deviations from the mean of all rows so far; null where they do not vary."""
    frame = in_time().rowsBetween(W.unboundedPreceding, 0)
    return guarded(ratio(F.col(column) - F.avg(column).over(frame), F.stddev_samp(column).over(frame)), column, frame, least)


def rolling_z(column: str, n: int = YEAR, least: int = 60, floor: float = 1e-8) -> Column:
    frame = last_rows(n)
    return guarded((F.col(column) - F.avg(column).over(frame)) / F.greatest(F.stddev_samp(column).over(frame), F.lit(floor)), column, frame, least)


def safe_corr(x: Column, y: Column, frame: WindowSpec | None = None) -> Column:
    """Pearson's correlation over pairs without nulls; null where a side is constant, where ``corr`` raises."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    c, a, b = (p.over(frame) if frame is not None else p for p in parts)
    return F.try_divide(c, a * b)


def autocorrelation(df: DataFrame, column: str, n: int = 60, out: str = "autocorr") -> DataFrame:
    """Correlation of neighbours inside the last n rows."""
    df = df.withColumns({"_lag": F.lag(column).over(in_time()), "_rn": F.row_number().over(in_time())})
    return df.withColumn(out, F.when(F.col("_rn") >= n, safe_corr(F.col(column), F.col("_lag"), last_rows(n - 1)))).drop("_lag", "_rn")


def variance_ratio(df: DataFrame, column: str, n: int = 60, q: int = 5, out: str = "vr") -> DataFrame:
    """Variance of overlapping q-sums inside the last n rows over q times the variance of the rows; null unless all n have a value."""
    df = df.withColumn("_sum", guarded(F.sum(column).over(last_rows(q)), column, last_rows(q), q))
    full = guarded(F.var_samp(column).over(last_rows(n)), column, last_rows(n), n)
    return df.withColumn(out, ratio(F.var_samp("_sum").over(last_rows(n - q + 1)), full * q)).drop("_sum")


def ljung_box(df: DataFrame, column: str, n: int = 60, lags: int = 10, q: str = "lb_q", p: str = "lb_pval") -> DataFrame:
    """Q = n (n + 2) sum of r_k^2 / (n - k), r_k the correlation of the pairs k rows apart inside the last n rows, and its p value.

    A lag whose pairs do not vary counts as 0. Null unless all n rows have a value.
    """
    df = df.withColumns({f"_l{k}": F.lag(column, k).over(in_time()) for k in range(1, lags + 1)})
    df = df.withColumns({f"_r{k}": F.coalesce(safe_corr(F.col(column), F.col(f"_l{k}"), last_rows(n - k)), F.lit(0.0)) for k in range(1, lags + 1)})
    total = sum((F.col(f"_r{k}") * F.col(f"_r{k}") / (n - k) for k in range(1, lags + 1)), F.lit(0.0))
    df = df.withColumn(q, guarded(n * (n + 2) * total, column, last_rows(n), n))
    return df.withColumn(p, chi2_sf(F.col(q), lags)).drop(*(f"_{x}{k}" for x in "lr" for k in range(1, lags + 1)))


def shifted_quantile(column: str, n: int = YEAR, share: float = 0.4) -> Column:
    """The interpolated quantile of the n rows before the current one; null unless all have a value."""
    frame = last_rows(n, skip=1)
    return guarded(F.percentile(column, F.lit(share)).over(frame), column, frame, n)


def tercile_state(column: str, least: int = 60) -> Column:
    """low, medium or high against the 33rd and 67th percentile of strictly earlier rows; medium for the first ``least`` rows."""
    frame, x = in_time().rowsBetween(W.unboundedPreceding, -1), F.col(column)
    low, high = (F.percentile(column, F.lit(s)).over(frame) for s in (0.33, 0.67))
    state = F.when(x <= low, "low").when(x >= high, "high").otherwise("medium")
    return F.when(x.isNotNull(), F.when(F.count(column).over(frame) < least, "medium").otherwise(state))


def tercile_states(df: DataFrame, column: str, least: int = 60, size: int = 4096, out: str = "state") -> DataFrame:
    """``df`` with ``tercile_state``, from quantiles by blocks of ``size`` rows: n log n work instead of a look at all earlier rows for each. A series' times differ."""
    x = F.col(column)
    state = F.when(x <= F.col("_low"), "low").when(x >= F.col("_high"), "high").otherwise("medium")
    df = earlier_quantiles(df, column, {"_low": 0.33, "_high": 0.67}, "_earlier", size)
    return df.withColumn(out, F.when(x.isNotNull(), F.when(F.col("_earlier") < least, "medium").otherwise(state))).drop("_low", "_high", "_earlier")


def drawdown(column: str, form: str = "wealth") -> Column:
    """From the running peak: relative for wealth or prices, absolute for sums."""
    peak = F.max(column).over(in_time().rowsBetween(W.unboundedPreceding, 0))
    return ratio(F.col(column), peak) - 1 if form == "wealth" else F.col(column) - peak


def difference(column: str, k: int = 1) -> Column:
    return F.col(column) - F.lag(column, k).over(in_time())


def volatility_ratio(column: str, short: int = 20, long: int = YEAR, least: int = 60) -> Column:
    return ratio(rolling_std(column, short, short // 2), rolling_std(column, long, least))


def move_to_volatility(df: DataFrame, column: str, n: int = 20, out: str = "move") -> DataFrame:
    """Rolling mean of |r| over its rolling deviation: illiquidity where there is no volume."""
    df = df.withColumn("_x", ratio(F.abs(F.col(column)), rolling_std(column, n, n // 2)))
    return df.withColumn(out, rolling_mean("_x", n, n // 2)).drop("_x")


def amihud(df: DataFrame, ret: str = "ret", volume: str = "dollar_volume", n: int = 20, least: int = 10, out: str = "amihud", scale: float = 1e6) -> DataFrame:
    """Rolling mean of |return| over traded value; a day without trade counts as missing."""
    df = df.withColumn("_x", ratio(F.abs(F.col(ret)) * scale, F.col(volume)))
    return df.withColumn(out, rolling_mean("_x", n, least)).drop("_x")


def hopping(df: DataFrame, n: int = YEAR, step: int = 21) -> DataFrame:
    """Each row once for each full window (win, from 0) of n rows that holds it; windows begin every ``step`` rows."""
    rows = W.partitionBy("series_id")
    df = df.withColumns({"_rn": F.row_number().over(in_time()) - 1, "_n": F.count("*").over(rows)})
    last = F.least(F.floor(F.col("_rn") / step), F.floor((F.col("_n") - n) / step))
    first = F.greatest(F.ceil((F.col("_rn") - n + 1) / step), F.lit(0))
    return df.where(F.col("_n") >= n).withColumn("win", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))).drop("_rn", "_n")


def spells(df: DataFrame, label: str = "label") -> DataFrame:
    """(series_id, spell, label, start, stop, n) of each run of equal labels; null labels are no part of one and end none."""
    df = df.where(F.col(label).isNotNull())
    new = F.coalesce((F.col(label) != F.lag(label).over(in_time())).cast("int"), F.lit(1))
    df = df.withColumn("_new", new).withColumn("spell", F.sum("_new").over(in_time().rowsBetween(W.unboundedPreceding, 0)))
    return df.groupBy("series_id", "spell", F.col(label).alias("label")).agg(F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count("*").alias("n"))


def switches(df: DataFrame, label: str = "label") -> DataFrame:
    """(series_id, n, switches, share, mean_spell) of a 0/1 label."""
    df = df.where(F.col(label).isNotNull()).withColumn("_s", F.coalesce((F.col(label) != F.lag(label).over(in_time())).cast("int"), F.lit(0)))
    g = df.groupBy("series_id").agg(F.count("*").alias("n"), F.sum("_s").alias("switches"), F.avg(F.col(label).cast("double")).alias("share"))
    return g.withColumn("mean_spell", F.col("n") / (F.col("switches") + 1))


def detection(df: DataFrame, truth: str = "truth", label: str = "label") -> DataFrame:
    """(series_id, n_spells, median_delay, missed): rows from the start of a true spell of 1 to the first estimated 1 inside it, and the share of spells without one."""
    df = df.withColumn("_rn", F.row_number().over(in_time())).where(F.col(truth).isNotNull())
    new = F.coalesce((F.col(truth) != F.lag(truth).over(in_time())).cast("int"), F.lit(1))
    df = df.withColumn("_new", new).withColumn("_spell", F.sum("_new").over(in_time().rowsBetween(W.unboundedPreceding, 0)))
    by = df.where(F.col(truth) == 1).groupBy("series_id", "_spell").agg((F.min(F.when(F.col(label) == 1, F.col("_rn"))) - F.min("_rn")).alias("delay"))
    return by.groupBy("series_id").agg(
        F.count("*").alias("n_spells"), F.percentile("delay", F.lit(0.5)).alias("median_delay"), F.avg(F.col("delay").isNull().cast("double")).alias("missed")
    )


def episode_lags(df: DataFrame, events: DataFrame, horizon: int = 126, label: str = "label") -> DataFrame:
    """Each event (series_id, ts) with ``lag``, the rows from it to the first label of 1 among the ``horizon`` rows from it; null if there is none.

    The next 1 at or after each row is a running minimum from the end, so an event needs only its own row.
    """
    df = df.withColumn("_rn", F.row_number().over(in_time()))
    following = in_time().rowsBetween(0, horizon - 1)
    df = df.withColumn("lag", F.min(F.when(F.col(label) == 1, F.col("_rn"))).over(following) - F.col("_rn"))
    return events.select("series_id", "ts").join(df.select("series_id", "ts", "lag"), ["series_id", "ts"], "left")
