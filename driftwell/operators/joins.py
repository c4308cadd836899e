"""Joins of panels with calendars, markets, events and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def on_dates(panel: DataFrame, market: DataFrame) -> DataFrame:
    """Rows of both on the dates that both have."""
    return panel.join(market, "ts", "inner")


def aligned(*series: DataFrame, names: list[str]) -> DataFrame:
    """(ts, one column a name) on the dates of any series (ts, value): one union and one aggregate, however many there are."""
    parts = [s.select("ts", F.lit(n).alias("name"), F.col("value").cast("double").alias("value")) for s, n in zip(series, names)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("ts").agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names))


def as_of(left: DataFrame, right: DataFrame, value: str, out: str | None = None, by: str | None = None, strict: bool = False) -> DataFrame:
    """``left`` with the last non-null value of ``right`` at or before its date (before, if strict).

    Both sides in one sorted column with a running last value: no range of right rows is ever paired with a left row.
    """
    keys = [by] if by else []
    out = out or value
    l = left.withColumns({"_side": F.lit(0 if strict else 1), out: F.lit(None).cast(right.schema[value].dataType)})  # noqa: E741
    r = right.select(*keys, "ts", F.lit(1 if strict else 0).alias("_side"), F.col(value).alias(out))
    both = l.unionByName(r.withColumn("_right", F.lit(True)), allowMissingColumns=True)
    frame = W.partitionBy(*keys).orderBy("ts", "_side").rowsBetween(W.unboundedPreceding, 0)
    filled = both.withColumn(out, F.last(out, ignorenulls=True).over(frame))
    return filled.where(F.col("_right").isNull()).drop("_side", "_right")


def missing(expected: DataFrame, found: DataFrame, key: str = "series_id") -> DataFrame:
    return expected.join(found, key, "left_anti")


def method_pairs(labels: DataFrame) -> DataFrame:
    """(series_id, ts, a, b, label_a, label_b) of every two methods (a < b) that label a row.

    A row's labels meet in one aggregate over the methods, of which there are few, instead of a self join of the table.
    """
    rows = labels.where("label is not null").groupBy("series_id", "ts").agg(F.sort_array(F.collect_list(F.struct("method", "label"))).alias("m"))
    one = rows.select("series_id", "ts", F.posexplode("m").alias("i", "x"), "m")
    two = one.select("series_id", "ts", "x", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("y"))
    return two.select("series_id", "ts", F.col("x.method").alias("a"), F.col("y.method").alias("b"), F.col("x.label").alias("label_a"), F.col("y.label").alias("label_b"))


def weekdays(df: DataFrame) -> DataFrame:
    """(ts) of all weekdays from the first to the last date of ``df``."""
    ends = df.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("ts")).where(F.weekday("ts") < 5)
