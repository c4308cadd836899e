"""How close a series is to a random walk: Hurst exponent, and the composite with variance ratio and Ljung-Box."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.functions.columns import clipped
from driftwell.operators.cleaning import in_time
from driftwell.operators.rolling import ljung_box, variance_ratio


def rescaled_range_lags(n: int) -> list[int]:
    return list(range(10, min(n // 2, 100), max(1, n // 40)))


def hurst_of(windows: np.ndarray) -> np.ndarray:
    """The slope of log mean R/S on log lag, for each row of ``windows``; NaN with under 20 values or 4 lags.

    Chunks of a lag begin at 0, lag, ... below n - lag, which leaves out a last chunk that ends with the window.
    """
    m, n = windows.shape
    if n < 20:
        return np.full(m, np.nan)
    xs, ys = [], []
    for lag in rescaled_range_lags(n):
        starts = np.arange(0, n - lag, lag)
        chunks = windows[:, starts[:, None] + np.arange(lag)]
        walk = np.cumsum(chunks - chunks.mean(axis=2, keepdims=True), axis=2)
        spread = walk.max(axis=2) - walk.min(axis=2)
        sd = chunks.std(axis=2, ddof=1)
        ok = sd > 0
        n_ok = ok.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            rs = np.where(ok, spread / np.where(ok, sd, 1), 0).sum(axis=1) / n_ok
            y = np.where((n_ok > 0) & (rs > 0), np.log(rs), np.nan)
        xs.append(np.log(lag))
        ys.append(y)
    x, y = np.array(xs)[None, :], np.array(ys).T
    seen = ~np.isnan(y)
    k = seen.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        xm = np.where(seen, x, 0).sum(1) / k
        ym = np.where(seen, y, 0).sum(1) / k
        dx = np.where(seen, x - xm[:, None], 0)
        slope = (dx * np.where(seen, y - ym[:, None], 0)).sum(1) / (dx * dx).sum(1)
    return np.where(k >= 4, slope, np.nan)


def rolling_hurst(df: DataFrame, column: str = "ret", n: int = 252, out: str = "hurst", block: int = 512) -> DataFrame:
    """Hurst exponent of the last n rows; null unless all have a value.

    The window of a row travels with it as an array only inside a block: rows are cut into blocks of a series with n - 1 rows
    before them, and a task slides over one block at a time.
    """
    rows = df.withColumns({"_x": F.col(column).cast("double"), "_rn": F.row_number().over(in_time()) - 1})
    rows = rows.withColumn("_b", F.floor(F.col("_rn") / block))
    slim = rows.select("series_id", "_rn", "_x", F.explode(F.sequence(F.floor(F.col("_rn") / block), F.floor((F.col("_rn") + n - 1) / block))).alias("_b"))

    def slide(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_rn")
        x, rn, b = p["_x"].to_numpy(float), p["_rn"].to_numpy(), int(p["_b"].iloc[0])
        own = np.flatnonzero((rn >= b * block) & (rn < (b + 1) * block))
        got = np.full(len(own), np.nan)
        full = own >= n - 1
        if full.any():
            windows = np.lib.stride_tricks.sliding_window_view(x, n)[own[full] - n + 1]
            good = ~np.isnan(windows).any(axis=1)
            values = np.full(len(windows), np.nan)
            if good.any():
                values[good] = hurst_of(windows[good])
            got[full] = values
        return pd.DataFrame({"series_id": p["series_id"].iloc[own].to_numpy(), "_rn": rn[own], out: got})

    kind = dict(df.dtypes)["series_id"]
    found = slim.groupBy("series_id", "_b").applyInPandas(slide, f"series_id {kind}, _rn int, `{out}` double")
    found = found.withColumn(out, F.when(~F.isnan(out), F.col(out)))
    return rows.drop("_x", "_b").join(found, ["series_id", "_rn"]).drop("_rn")


def hurst_dyadic(values: pd.Series) -> float:
    """The whole-series variant: chunk sizes n/16 to n/2 by doubling, population deviations, clipped to [0, 1], 0.5 for short input."""
    x = values.dropna().to_numpy(float)
    n = len(x)
    if n < 32:
        return 0.5
    logs = []
    size = max(n // 16, 4)
    while size <= n // 2:
        chunks = x[: n // size * size].reshape(-1, size)
        walk = np.cumsum(chunks - chunks.mean(1, keepdims=True), axis=1)
        sd = chunks.std(1)
        ok = sd > 0
        if ok.any():
            logs.append((np.log(size), np.log(((walk.max(1) - walk.min(1))[ok] / sd[ok]).mean())))
        size *= 2
    if len(logs) < 2:
        return 0.5
    return float(np.clip(np.polyfit(*np.array(logs).T, 1)[0], 0, 1))


def series_hurst(df: DataFrame, column: str = "ret") -> DataFrame:
    """(series_id, hurst) by the dyadic variant, one series a group."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"series_id": [p["series_id"].iloc[0]], "hurst": [hurst_dyadic(p.sort_values("ts")[column])]})

    return df.select("series_id", "ts", column).groupBy("series_id").applyInPandas(run, f"series_id {dict(df.dtypes)['series_id']}, hurst double")


def composite(df: DataFrame, hurst: str = "hurst", vr: str = "vr", p: str = "lb_pval") -> DataFrame:
    """hurst_eff, vr_eff and lb_eff in [0, 1], efficiency (their mean), inefficiency and direction (positive: trending); null where a part is."""
    h, v = F.col(hurst), F.col(vr)
    df = df.withColumns({"hurst_eff": clipped(1 - 2 * F.abs(h - 0.5), 0, 1), "vr_eff": 1 / (1 + F.abs(v - 1)), "lb_eff": clipped(F.col(p), 0, 1)})
    df = df.withColumn("efficiency", clipped((F.col("hurst_eff") + F.col("vr_eff") + F.col("lb_eff")) / 3, 0, 1))
    return df.withColumns({"inefficiency": 1 - F.col("efficiency"), "direction": ((h - 0.5) + (v - 1)) / 2})


def efficiency_score(df: DataFrame, column: str = "ret", hurst_rows: int = 252, vr_rows: int = 60, q: int = 5, lb_rows: int = 60, lags: int = 10) -> DataFrame:
    """All parts and the composite for each row of a panel."""
    df = ljung_box(variance_ratio(df, column, vr_rows, q), column, lb_rows, lags)
    return composite(rolling_hurst(df, column, hurst_rows))


def native_efficiency(df: DataFrame, column: str = "ret", n: int = 60, q: int = 5, lags: int = 10) -> DataFrame:
    """Variance-ratio and Ljung-Box parts only, by expressions."""
    df = ljung_box(variance_ratio(df, column, n, q), column, n, lags)
    return df.withColumns({"vr_eff": 1 / (1 + F.abs(F.col("vr") - 1)), "lb_eff": clipped(F.col("lb_pval"), 0, 1)})


