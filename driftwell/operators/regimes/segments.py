"""Change points of mean and variance: the best of all segmentations by pruned dynamic programming, or greedy binary
splits as window aggregates; and volatility clusters of the segments by exact two-means.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwell.operators.blocks import numbered, saved


def _cost(n, s1, s2):
    """n ln(variance) from sums of x and x squared."""
    return n * F.log(F.greatest(s2 / n - (s1 / n) * (s1 / n), F.lit(1e-12)))


def segmented(df: DataFrame, column: str = "ret", penalty: float = 3.0, least: int = 21) -> DataFrame:
    """(series_id, ts, x, segment): each level splits every segment where its cost falls most, if that is over penalty * ln(rows of the series), until none is."""
    rows = df.where(F.col(column).isNotNull()).select("series_id", "ts", F.col(column).cast("double").alias("x"))
    whole = W.partitionBy("series_id")
    # centred first, so that sums of squares keep their digits
    rows = rows.withColumns({"y": F.col("x") - F.avg("x").over(whole), "total": F.count("*").over(whole), "segment": F.lit("1")})
    rows = saved(rows)
    while True:
        seg = W.partitionBy("series_id", "segment")
        run = seg.orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
        p = rows.withColumns({"i": F.row_number().over(seg.orderBy("ts")), "a1": F.sum("y").over(run), "a2": F.sum(F.col("y") * F.col("y")).over(run)})
        p = p.withColumns({"n": F.count("*").over(seg), "t1": F.sum("y").over(seg), "t2": F.sum(F.col("y") * F.col("y")).over(seg)})
        i, n = F.col("i"), F.col("n")
        gain = _cost(n, F.col("t1"), F.col("t2")) - _cost(i, F.col("a1"), F.col("a2")) - _cost(n - i, F.col("t1") - F.col("a1"), F.col("t2") - F.col("a2"))
        tried = p.where((i >= least) & (n - i >= least)).withColumn("gain", gain)
        best = tried.groupBy("series_id", "segment").agg(F.max(F.struct("gain", (-F.unix_date(F.to_date("ts"))).alias("d"), "ts", "total")).alias("b"))
        cuts = saved(best.where(F.col("b.gain") > penalty * F.log("b.total")).select("series_id", "segment", F.col("b.ts").alias("cut")))
        if cuts.isEmpty():
            break
        side = F.when(F.col("cut").isNull(), F.col("segment")).otherwise(F.concat("segment", F.when(F.col("ts") <= F.col("cut"), "0").otherwise("1")))
        rows = saved(rows.join(cuts, ["series_id", "segment"], "left").withColumn("segment", side).drop("cut"))
    return rows.select("series_id", "ts", "x", "segment")


def cheapest(n: np.ndarray, s1: np.ndarray, s2: np.ndarray, penalty: float, least: int, floor: float = 1e-6, pruned: bool = True) -> tuple[list[int], float]:
    """(cells where segments begin, cost) of the cheapest segmentation of cells with ``n`` values, their sums and sums of squares.

    A segment costs its values times ln(variance + floor), plus the penalty, and has ``least`` values or more; fewer in all are one segment. Since a
    segment never costs less than its halves without penalty, a beginning that is dearer than the cheapest segmentation up to some end,
    penalty included, is never needed by segments that end ``least`` values after that end or later: there the other beginning is as near.
    Ties go to the longest last segment.
    """
    at, a1, a2 = (np.append(0.0, np.cumsum(x)) for x in (n, s1, s2))
    m = len(n)

    def cost(starts: np.ndarray, end: int) -> np.ndarray:
        size = at[end] - at[starts]
        mean = (a1[end] - a1[starts]) / size
        return size * np.log(np.maximum((a2[end] - a2[starts]) / size - mean * mean, 0.0) + floor)

    best, last = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
    best[0] = 0.0
    if at[m] < 2 * least:
        return [0], float(cost(np.array([0]), m)[0] + penalty) if m else 0.0
    open_, until, entered = np.zeros(0, np.int64), np.zeros(0), 0
    for end in range(1, m + 1):
        fresh = []
        while entered < end and at[end] - at[entered] >= least:
            if np.isfinite(best[entered]):
                fresh.append(entered)
            entered += 1
        keep = until > at[end]
        open_, until = np.append(open_[keep], fresh).astype(np.int64), np.append(until[keep], np.full(len(fresh), np.inf))
        if not len(open_):
            continue
        value = best[open_] + cost(open_, end)
        i = int(np.argmin(value))
        best[end], last[end] = value[i] + penalty, open_[i]
        if pruned:
            until = np.where((value > best[end]) & np.isinf(until), at[end] + least, until)
    starts, end = [], m
    while end > 0:
        end = int(last[end])
        starts.append(end)
    return starts[::-1], float(best[m])


def optimal(df: DataFrame, column: str = "ret", penalty: float = 3.0, least: int = 21, grid: int = 5, floor: float = 1e-6) -> DataFrame:
    """(series_id, ts, x, segment, cost): segments, from 0, of the cheapest segmentation of each series among boundaries at every ``grid`` rows,
    with ``penalty`` * ln(rows of the series) a segment; ``cost`` is that of the whole segmentation.

    Rows are numbered in ranges and summed by cell of ``grid`` rows; the search sees three numbers a cell, and its labels go back to the rows
    by a join on cells, so no task holds the rows of a series. Rows whose value is null are left out.
    """
    series = dict(df.dtypes)["series_id"]
    rows = numbered(df.where(F.col(column).isNotNull()).select("series_id", "ts", F.col(column).cast("double").alias("x")))
    rows = saved(rows.select("series_id", "ts", "x", F.floor(F.col("rn") / grid).alias("cell")))
    # centred first, so that sums of squares keep their digits
    means = rows.groupBy("series_id").agg(F.avg("x").alias("mean"))
    y = F.col("x") - F.col("mean")
    cells = rows.join(means, "series_id").groupBy("series_id", "cell").agg(F.count("*").alias("n"), F.sum(y).alias("s1"), F.sum(y * y).alias("s2"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("cell")
        n = p["n"].to_numpy(float)
        starts, cost = cheapest(n, p["s1"].to_numpy(float), p["s2"].to_numpy(float), penalty * np.log(n.sum()), least, floor)
        segment = np.repeat(np.arange(len(starts)), np.diff([*starts, len(n)]))
        return pd.DataFrame({"series_id": p["series_id"], "cell": p["cell"], "segment": segment, "cost": cost})

    found = cells.groupBy("series_id").applyInPandas(run, f"series_id {series}, cell long, segment int, cost double")
    return rows.join(found, ["series_id", "cell"]).select("series_id", "ts", "x", "segment", "cost")


def cost(rows: DataFrame, penalty: float = 3.0, floor: float = 1e-6) -> DataFrame:
    """(series_id, segments, cost) of a segmentation, by the measure of ``optimal``."""
    segs = rows.groupBy("series_id", "segment").agg(F.count("*").alias("n"), F.var_pop("x").alias("var"))
    total = F.sum(F.col("n") * F.log(F.col("var") + floor)) + penalty * F.count("*") * F.log(F.sum("n"))
    return segs.groupBy("series_id").agg(F.count("*").alias("segments"), total.alias("cost"))


def clustered(rows: DataFrame) -> DataFrame:
    """(series_id, segment, start, stop, n, sd, label): 1 for the segments of the upper of two clusters of log deviation.

    The best cut of values in order is found from sums before and after each.
    """
    segs = rows.groupBy("series_id", "segment").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count("*").alias("n"), F.stddev_pop("x").alias("sd"))
    segs = segs.withColumn("v", F.log(F.greatest("sd", F.lit(1e-12))))
    order = W.partitionBy("series_id").orderBy("v", "segment")
    up, all_ = order.rowsBetween(W.unboundedPreceding, 0), W.partitionBy("series_id")
    s = segs.withColumns({"i": F.row_number().over(order), "m": F.count("*").over(all_), "a": F.sum("v").over(up), "t": F.sum("v").over(all_)})
    between = F.try_divide(F.col("a") * F.col("a"), F.col("i")) + F.try_divide((F.col("t") - F.col("a")) * (F.col("t") - F.col("a")), F.col("m") - F.col("i"))
    cut = s.where("i < m").withColumn("b", between).groupBy("series_id").agg(F.max(F.struct("b", (-F.col("i")).alias("i"))).alias("c"))
    out = s.join(cut, "series_id", "left")
    return out.select("series_id", "segment", "start", "stop", "n", "sd", F.coalesce((F.col("i") > -F.col("c.i")).cast("int"), F.lit(0)).alias("label"))
