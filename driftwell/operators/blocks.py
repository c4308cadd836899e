"""Long single series: rows are numbered without a window over the whole series, bounded frames run on blocks with a halo, and
recursions run as a scan over blocks."""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftwell.sources.shared import saved


def numbered(df: DataFrame, size: int = 4096, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """``df`` with rn (from 0, in time order of its series, or in another ``order``) and block (rn div size).

    Rows are dealt to ranges of (series_id, ts) and numbered inside a range; a range's rows of a series come after those of the
    ranges before. Only one row a range and series is summed in order. The ranges are written once, since they come from a
    sample and could be others when made again.
    """
    dealt = df.repartitionByRange("series_id", *order).withColumn("_range", F.spark_partition_id())
    dealt = saved(dealt)
    sizes = dealt.groupBy("series_id", "_range").count()
    before = sizes.select("series_id", "_range", (F.sum("count").over(W.partitionBy("series_id").orderBy("_range")) - F.col("count")).alias("_before"))
    own = F.row_number().over(W.partitionBy("series_id", "_range").orderBy(*order)) - 1
    out = dealt.withColumn("_own", own).join(before, ["series_id", "_range"]).withColumn("rn", F.col("_own") + F.col("_before"))
    return out.withColumn("block", F.floor(F.col("rn") / size)).drop("_range", "_own", "_before")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to four tasks a core, for groups that take long for their bytes: a number that is asked for is not coalesced."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def in_blocks(df: DataFrame, halo: int, operator, size: int = 4096) -> DataFrame:
    """``operator(df)`` of operators whose frames reach at most ``halo`` rows back, run on blocks of a series.

    Each row also goes to the next block if it is within ``halo`` rows of that block's start. The operator sees a series id that
    names series and block, so its windows hold one block and its halo; halo rows are dropped afterwards. Minimum counts of
    rows hold as in one window, if ``halo`` is at least the frame.
    """
    columns = df.columns
    rows = numbered(df, size)
    reach = F.floor((F.col("rn") + halo) / size)
    rows = rows.withColumn("_to", F.explode(F.sequence(F.col("block"), reach)))
    rows = rows.withColumns({"_series": F.col("series_id"), "_halo": F.col("_to") != F.col("block")})
    rows = rows.withColumn("series_id", F.concat_ws("\x1f", F.col("series_id").cast("string"), F.col("_to").cast("string")))
    done = operator(rows).where(~F.col("_halo"))
    new = [c for c in done.columns if c not in rows.columns]
    return done.select(F.col("_series").alias("series_id"), *(c for c in columns if c != "series_id"), *new)


def affine_scan(df: DataFrame, a: str, b: str, out: str, start: str | None = None, size: int = 4096) -> DataFrame:
    """``df`` with out_t = a_t * out_{t-1} + b_t in time order of each series, from 0, or from ``start`` of the first row.

    A block is one affine map: (product of a, value from 0). Maps of a series' blocks are composed in order, one row a block,
    and each block is replayed from its carry. A null a or b leaves the value as it was.
    """
    rows = saved(numbered(df, size))
    kinds = dict(rows.dtypes)

    def summary(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rn")
        x, y = p[a].to_numpy(float), p[b].to_numpy(float)
        skip = np.isnan(x) | np.isnan(y)
        x, y = np.where(skip, 1.0, x), np.where(skip, 0.0, y)
        value, slope = 0.0, 1.0
        for u, v in zip(x, y):
            value, slope = u * value + v, slope * u
        return pd.DataFrame({"series_id": [p["series_id"].iloc[0]], "block": [p["block"].iloc[0]], "slope": [slope], "value": [value], "s": [float(p[start].iloc[0]) if start else 0.0]})

    series = kinds["series_id"]
    maps = rows.select("series_id", "block", "rn", a, b, *([start] if start and start not in (a, b) else [])).groupBy("series_id", "block").applyInPandas(summary, f"series_id {series}, block long, slope double, value double, s double")

    def carried(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("block")
        carry, now = [], float(p["s"].iloc[0])
        for u, v in zip(p["slope"], p["value"]):
            carry.append(now)
            now = u * now + v
        return pd.DataFrame({"series_id": p["series_id"], "block": p["block"], "carry": carry})

    carries = maps.groupBy("series_id").applyInPandas(carried, f"series_id {series}, block long, carry double")

    def replay(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rn")
        now, got = float(p["carry"].iloc[0]), []
        for u, v in zip(p[a].to_numpy(float), p[b].to_numpy(float)):
            if u == u and v == v:
                now = u * now + v
            got.append(now)
        return p.assign(**{out: got}).drop(columns=["carry"])

    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + f", `{out}` double"
    return rows.join(carries, ["series_id", "block"]).groupBy("series_id", "block").applyInPandas(replay, schema).drop("rn", "block")


def earlier_quantiles(df: DataFrame, column: str, outs: dict[str, float], count: str = "earlier", size: int = 4096) -> DataFrame:
    """``df`` with the interpolated quantiles of all strictly earlier values of each row's series, exactly, and how many they are; null where there is none.

    A series is cut twice: into blocks of ``size`` rows in time, and into buckets of ``size`` values in order. Counts of (block, bucket) tell which buckets hold the
    ranks that a quantile can reach while a block's rows come in; those buckets' earlier values go to the block, which puts its own in between, one by one. That moves
    n log n values; a task has one block with about two buckets a quantile of earlier values, or a series' counts, (n / size)^2 numbers. Null values count as missing rows.
    """
    shares = list(outs.values())
    kinds = dict(df.dtypes)
    series = kinds["series_id"]
    whole = df.where(F.col(column).isNotNull())
    rows = numbered(whole.select("series_id", "ts", F.col(column).cast("double").alias("x")), size).select("series_id", "ts", "x", "rn", "block")
    rows = saved(numbered(rows.withColumnRenamed("rn", "at").withColumnRenamed("block", "own"), size, ("x", "ts")).select("series_id", "ts", "x", "at", "own", F.col("block").alias("bucket")))
    counts = rows.groupBy("series_id", "own", "bucket").count()

    def wanted(p: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((int(p["own"].max()) + 1, int(p["bucket"].max()) + 1), np.int64)
        grid[p["own"], p["bucket"]] = p["count"]
        upto, out = np.zeros(grid.shape[1], np.int64), []
        for block, own in enumerate(grid):
            ends, m, n = np.cumsum(upto), int(upto.sum()), int(own.sum())
            for i, share in enumerate(shares):
                # ranks that the quantile's neighbours can have among the earlier values, n more coming in below or above
                low, high = int((max(m, 1) - 1) * share) - n - 1, int((m + n) * share) + 2
                a, b = np.searchsorted(ends, max(low, 0), "right"), min(np.searchsorted(ends, min(high, m), "left"), len(ends) - 1)
                if m:
                    out += [(block, i, c, int(ends[a - 1]) if a else 0) for c in range(int(a), int(b) + 1)]
            upto = upto + own
        found = pd.DataFrame(out, columns=["to", "share", "bucket", "below"])
        found.insert(0, "series_id", p["series_id"].iloc[0])
        return found

    asked = counts.groupBy("series_id").applyInPandas(wanted, f"series_id {series}, to long, share int, bucket long, below long")
    sent = rows.select("series_id", "bucket", "own", "x").join(asked, ["series_id", "bucket"]).where(F.col("own") < F.col("to")).select(F.col("series_id").alias("_series"), F.col("to").alias("_to"), "share", "below", F.col("x").alias("v"))

    def told(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("at")
        at, x = p["at"].to_numpy(), p["x"].tolist()
        done = {"series_id": p["series_id"], "ts": p["ts"], count: at}
        for i, (name, share) in enumerate(outs.items()):
            own = q[q["share"] == i]
            held, below, got = sorted(own["v"].tolist()), int(own["below"].iloc[0]) if len(own) else 0, []
            for m, v in zip(at.tolist(), x):
                if m:
                    h = (m - 1) * share
                    lo = int(h)
                    a = held[lo - below]
                    got.append(a + (held[lo + 1 - below] - a) * (h - lo) if h > lo else a)
                else:
                    got.append(None)
                insort(held, v)
            done[name] = pd.array(got, "Float64")
        return pd.DataFrame(done)

    schema = ", ".join([f"series_id {series}", f"ts {kinds['ts']}", f"{count} long", *(f"`{n}` double" for n in outs)])
    return df.join(rows.groupBy("series_id", "own").cogroup(sent.groupBy("_series", "_to")).applyInPandas(told, schema), ["series_id", "ts"], "left")


def recursion(u: np.ndarray, a: np.ndarray, start: np.ndarray) -> np.ndarray:
    """y_t = a y_(t-1) + u_t along the last axis, from ``start``: in doubling steps, so that time is no loop."""
    y = u.copy()
    y[..., 0] += a * start
    step, power = 1, np.array(a, float)
    while step < y.shape[-1] and np.any(np.abs(power) > 1e-300):
        y[..., step:] += power[..., None] * y[..., :-step].copy()
        step, power = 2 * step, power * power
    return y


def decayed(df: DataFrame, means: dict[str, tuple[str, float]], size: int = 4096) -> DataFrame:
    """``df`` with rn (from 0, in time order of its series), and for each name the mean of a column with weights that halve in so many rows.

    All means are one scan: a block ends with its weighted sums and the sum of weights, which are carried over blocks and decayed by its rows. Values are not null.
    """
    rows = saved(numbered(df, size))
    kinds, names = dict(rows.dtypes), list(means)
    series, columns = kinds["series_id"], [c for c, _ in means.values()]
    keep = np.array([0.5 ** (1 / h) for _, h in means.values()])

    def sums(p: pd.DataFrame, start: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return recursion(p[columns].to_numpy(float).T, keep, start), recursion(np.ones((len(keep), len(p))), keep, weight)

    def summary(p: pd.DataFrame) -> pd.DataFrame:
        own, weight = sums(p.sort_values("rn"), np.zeros(len(keep)), np.zeros(len(keep)))
        return pd.DataFrame({"series_id": [p["series_id"].iloc[0]], "block": [p["block"].iloc[0]], "rows": [len(p)], "own": [own[:, -1].tolist()], "weight": [weight[:, -1].tolist()]})

    parts = rows.groupBy("series_id", "block").applyInPandas(summary, f"series_id {series}, block long, rows int, own array<double>, weight array<double>")

    def carried(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("block")
        now, weight, out = np.zeros(len(keep)), np.zeros(len(keep)), []
        for n, own, w in zip(p["rows"], p["own"], p["weight"]):
            out.append([*now, *weight])
            now, weight = keep**n * now + own, keep**n * weight + w
        return pd.DataFrame({"series_id": p["series_id"], "block": p["block"], "carry": out})

    carries = parts.groupBy("series_id").applyInPandas(carried, f"series_id {series}, block long, carry array<double>")

    def replay(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rn")
        carry = np.asarray(p["carry"].iloc[0]).reshape(2, -1)
        own, weight = sums(p, *carry)
        return p.drop(columns=["carry"]).assign(**dict(zip(names, own / weight)))

    schema = ", ".join([*(f"`{c}` {t}" for c, t in kinds.items()), *(f"`{c}` double" for c in names)])
    return rows.join(carries, ["series_id", "block"]).groupBy("series_id", "block").applyInPandas(replay, schema).drop("block")


def ewma(df: DataFrame, column: str, out: str, alpha: float | None = None, half_life: float | None = None, size: int = 4096) -> DataFrame:
    """Exponentially weighted mean: with ``alpha``, y = (1 - alpha) y + alpha x from the first row; with ``half_life``, weights that halve in so many rows, over their sum."""
    if half_life is None:
        df = df.withColumns({"_a": F.lit(1 - alpha), "_b": F.lit(alpha) * F.col(column)})
        return affine_scan(df, "_a", "_b", out, start=column, size=size).drop("_a", "_b")
    keep = 0.5 ** (1 / half_life)
    df = df.withColumns({"_a": F.when(F.col(column).isNotNull(), F.lit(keep)), "_b": F.col(column), "_one": F.when(F.col(column).isNotNull(), F.lit(1.0))})
    df = affine_scan(affine_scan(df, "_a", "_b", "_num", size=size), "_a", "_one", "_den", size=size)
    return df.withColumn(out, F.try_divide("_num", "_den")).drop("_a", "_b", "_one", "_num", "_den")
