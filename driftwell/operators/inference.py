"""Tests and estimators as aggregates: moments first, small arithmetic on what is left."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from driftwell.functions.columns import ratio
from driftwell.functions.distributions import normal_cdf, normal_ppf
from driftwell.operators import ranks
from driftwell.operators.cleaning import in_time
from driftwell.operators.rolling import YEAR
from driftwell.sources.shared import saved, written


def sharpe(x: str) -> Column:
    """Annualised; null with under 5 values or no deviation."""
    ok = (F.count(x) >= 5) & (F.stddev_samp(x) > 0)
    return F.when(ok, F.try_divide(F.avg(x), F.stddev_samp(x)) * math.sqrt(YEAR))


def auc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """(by, n_pos, n_neg, auc) by average ranks: distinct scores are counted first, and only they are put in order."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    g = rows.groupBy(*by, score).agg(F.sum((F.col(label) == 1).cast("long")).alias("_p"), F.sum((F.col(label) != 1).cast("long")).alias("_q"))
    below = F.coalesce(F.sum("_q").over(W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    g = g.withColumn("_w", F.col("_p") * (below + F.col("_q") / 2))
    out = g.groupBy(*by).agg(F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"), F.sum("_w").alias("_w"))
    return out.select(*by, "n_pos", "n_neg", ratio(F.col("_w"), F.col("n_pos") * F.col("n_neg")).alias("auc"))


def classification(df: DataFrame, predicted: str, label: str, by: list[str]) -> DataFrame:
    """(by, n, accuracy, majority, precision, recall, base_rate) of 0/1 columns."""
    p, y = F.col(predicted) == 1, F.col(label) == 1
    rows = df.where(F.col(predicted).isNotNull() & F.col(label).isNotNull())
    share = lambda c: F.avg(c.cast("double"))
    base = share(y)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), share(p == y).alias("accuracy"), F.greatest(base, 1 - base).alias("majority"), F.avg(F.when(p, y.cast("double"))).alias("precision"),
        F.avg(F.when(y, p.cast("double"))).alias("recall"), base.alias("base_rate"),
    )


def kappa(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(by, n, agreement, kappa) of two 0/1 labels; null kappa where chance alone agrees fully."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    g = df.where(x.isNotNull() & y.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg((x == y).cast("double")).alias("agreement"), F.avg(x).alias("_x"), F.avg(y).alias("_y"))
    chance = F.col("_x") * F.col("_y") + (1 - F.col("_x")) * (1 - F.col("_y"))
    return g.withColumn("kappa", F.when(1 - chance > 1e-12, ratio(F.col("agreement") - chance, 1 - chance))).drop("_x", "_y")


def balanced_accuracy(df: DataFrame, label: str, truth: str, by: list[str]) -> DataFrame:
    """The mean recall of the classes that occur."""
    rows = df.where(F.col(label).isNotNull() & F.col(truth).isNotNull())
    recall = rows.groupBy(*by, truth).agg(F.avg((F.col(label) == F.col(truth)).cast("double")).alias("r"))
    return recall.groupBy(*by).agg(F.count("*").alias("classes"), F.avg("r").alias("balanced_accuracy"))


def diff_variance_ratio(df: DataFrame, column: str, lags: tuple[int, ...] = (2, 5, 10)) -> DataFrame:
    """(series_id, q, n, vr, z) of the variance of q-row differences over q times that of one-row differences."""
    x = F.col(column)
    df = df.withColumns({f"_d{q}": x - F.lag(column, q).over(in_time()) for q in (1, *lags)})
    g = df.groupBy("series_id").agg(F.count(column).alias("n"), *(F.var_pop(f"_d{q}").alias(f"v{q}") for q in (1, *lags)))
    rows = F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"v{q}").alias("v")) for q in lags)))
    g = g.select("series_id", "n", "v1", rows.alias("r")).select("series_id", "n", F.col("r.q").alias("q"), ratio(F.col("r.v"), F.col("v1") * F.col("r.q")).alias("vr"))
    se = F.sqrt(2 * (2 * F.col("q") - 1) * (F.col("q") - 1) / (3 * F.col("q") * F.col("n")))
    return g.withColumn("z", F.try_divide(F.col("vr") - 1, se))


def robust_variance_ratio(df: DataFrame, column: str, q: int = 2, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(by, n, vr, z): heteroscedasticity-robust variance ratio test; rows of a group in time order."""
    over = W.partitionBy(*by)
    df = df.where(F.col(column).isNotNull())
    df = df.withColumn("_d", F.col(column) - F.avg(column).over(over))
    order = over.orderBy("ts")
    df = df.withColumn("_q", F.when(F.count("_d").over(order.rowsBetween(-(q - 1), 0)) == q, F.sum("_d").over(order.rowsBetween(-(q - 1), 0))))
    df = df.withColumns({f"_p{j}": F.pow(F.col("_d") * F.lag("_d", j).over(order), F.lit(2.0)) for j in range(1, q)})
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("s"), F.sum(F.col("_q") * F.col("_q")).alias("sq"), *(F.sum(f"_p{j}").alias(f"p{j}") for j in range(1, q)))
    n = F.col("n")
    theta = sum(((2 * (q - j) / q) ** 2 * n * F.try_divide(F.col(f"p{j}"), F.col("s") * F.col("s")) for j in range(1, q)), F.lit(0.0))
    vr = F.try_divide(F.col("sq") / (n * q), F.col("s") / n)
    return g.select(*by, "n", vr.alias("vr"), F.try_divide(vr - 1, F.sqrt(theta / n)).alias("z"))


def newey_west(df: DataFrame, column: str, lags: int = 10, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(by, n, mean, t): the mean over its Bartlett-weighted standard error."""
    over = W.partitionBy(*by)
    df = df.where(F.col(column).isNotNull()).withColumn("_e", F.col(column) - F.avg(column).over(over))
    order = over.orderBy("ts")
    df = df.withColumns({f"_g{k}": F.col("_e") * (F.lag("_e", k).over(order) if k else F.col("_e")) for k in range(lags + 1)})
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(column).alias("mean"), *(F.sum(f"_g{k}").alias(f"g{k}") for k in range(lags + 1)))
    n = F.col("n")
    var = F.col("g0") / n + sum((2 * (1 - k / (lags + 1)) * F.coalesce(F.col(f"g{k}"), F.lit(0.0)) / n for k in range(1, lags + 1)), F.lit(0.0))
    return g.select(*by, "n", "mean", F.when(var > 0, F.try_divide(F.col("mean"), F.sqrt(var / n))).alias("t"))


def diebold_mariano(df: DataFrame, first: str, second: str, lags: int = 10, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Newey-West test of the difference of two scores."""
    return newey_west(df.withColumn("_dm", F.col(first) - F.col(second)), "_dm", lags, by)


def ols_hc0(df: DataFrame, y: str, xs: list[str], by: list[str]) -> DataFrame:
    """(by, n, term, coef, t) of least squares with White's errors; rows with a null are left out.

    One aggregate for the normal equations, one for the residual-weighted products; systems of a few terms are solved in a
    pandas function a group, which gets one row.
    """
    k = len(xs)
    rows = df.dropna(subset=[y, *xs]).select(*by, F.col(y).cast("double").alias("_y"), *(F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)))
    gram = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")) for i in range(k) for j in range(k)]
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.array(*gram).alias("xx"), F.array(*(F.sum(F.col(f"_x{i}") * F.col("_y")) for i in range(k))).alias("xy"))

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.lstsq(np.array(a).reshape(k, k), np.array(b), rcond=None)[0].tolist() for a, b in zip(xx, xy)])

    fitted = g.withColumn("beta", solve("xx", "xy"))
    e = F.col("_y") - sum((F.col("beta")[i] * F.col(f"_x{i}") for i in range(k)), F.lit(0.0))
    joined = rows.join(fitted.select(*by, "beta"), by) if by else rows.crossJoin(F.broadcast(fitted.select("beta")))  # one row
    meat = joined.withColumn("_e2", e * e).groupBy(*by).agg(F.array(*(F.sum(F.col("_e2") * F.col(f"_x{i}") * F.col(f"_x{j}")) for i in range(k) for j in range(k))).alias("m"))

    @F.pandas_udf("array<double>")
    def errors(xx: pd.Series, m: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(xx, m):
            inverse = np.linalg.pinv(np.array(a).reshape(k, k))
            out.append(np.sqrt(np.maximum(np.diag(inverse @ np.array(b).reshape(k, k) @ inverse), 0)).tolist())
        return pd.Series(out)

    both = fitted.join(meat, by) if by else fitted.crossJoin(F.broadcast(meat))  # one row each
    done = both.withColumn("se", errors("xx", "m")).select(*by, "n", F.posexplode(F.arrays_zip("beta", "se")).alias("i", "z"))
    terms = F.array(*map(F.lit, xs))
    return done.select(*by, "n", terms[F.col("i")].alias("term"), F.col("z.beta").alias("coef"), F.try_divide(F.col("z.beta"), F.col("z.se")).alias("t"))


def ar1_by_state(df: DataFrame, column: str, state: str, by: list[str], least: int = 200, each: int = 50) -> DataFrame:
    """(by, n, low, high, gap, t): the AR(1) slope in state 0 and 1 of the row before; groups with too few rows are left out.

    With an intercept and slope for either state, least squares splits by state; so do White's errors.
    """
    order = W.partitionBy("series_id").orderBy("ts")
    df = df.withColumns({"_x": F.lag(column).over(order), "_s": F.lag(state).over(order)}).dropna(subset=[column, "_x", "_s"])
    by_state = [*by, "_s"]
    g = df.groupBy(*by_state).agg(F.count("*").alias("k"), F.regr_slope(column, "_x").alias("slope"), F.avg("_x").alias("mx"), F.avg(column).alias("my"), F.var_pop("_x").alias("v"))
    e = F.col(column) - F.col("my") - F.col("slope") * (F.col("_x") - F.col("mx"))
    meat = df.join(g, by_state).groupBy(*by_state).agg(F.sum(e * e * F.pow(F.col("_x") - F.col("mx"), F.lit(2.0))).alias("meat"))
    g = g.join(meat, by_state).withColumn("var", F.try_divide(F.col("meat"), F.pow(F.col("k") * F.col("v"), F.lit(2.0))))
    pick = lambda c, s: F.max(F.when(F.col("_s") == s, F.col(c)))
    out = g.groupBy(*by).agg(F.sum("k").alias("n"), pick("k", 0).alias("k0"), pick("k", 1).alias("k1"), pick("slope", 0).alias("low"), pick("slope", 1).alias("high"), pick("var", 0).alias("v0"), pick("var", 1).alias("v1"))
    out = out.where((F.col("n") >= least) & (F.col("k0") >= each) & (F.col("k1") >= each)).withColumn("gap", F.col("high") - F.col("low"))
    return out.select(*by, "n", "low", "high", "gap", F.try_divide(F.col("gap"), F.sqrt(F.col("v0") + F.col("v1"))).alias("t"))


def alpha_beta(df: DataFrame, y: str, x: str, by: list[str], lags: int = 10) -> DataFrame:
    """(by, n, alpha, beta, t_alpha) of y on x, with Bartlett-weighted errors of the scores for alpha."""
    df = df.dropna(subset=[y, x])
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.regr_intercept(y, x).alias("alpha"), F.regr_slope(y, x).alias("beta"), F.avg(x).alias("mx"), F.var_pop(x).alias("v"))
    order = W.partitionBy(*by).orderBy("ts")
    e = F.col(y) - F.col("alpha") - F.col("beta") * F.col(x)
    # alpha's influence: e * (1 - (x - mx) * mx / v)
    rows = df.join(g, by).withColumn("_u", e * (1 - F.try_divide((F.col(x) - F.col("mx")) * F.col("mx"), F.col("v"))))
    rows = rows.withColumns({f"_g{k}": F.col("_u") * (F.lag("_u", k).over(order) if k else F.col("_u")) for k in range(lags + 1)})
    s = rows.groupBy(*by).agg(*(F.sum(f"_g{k}").alias(f"g{k}") for k in range(lags + 1)))
    var = F.col("g0") + sum((2 * (1 - k / (lags + 1)) * F.coalesce(F.col(f"g{k}"), F.lit(0.0)) for k in range(1, lags + 1)), F.lit(0.0))
    return g.join(s, by).select(*by, "n", "alpha", "beta", F.when(var > 0, F.try_divide(F.col("alpha") * F.col("n"), F.sqrt(var))).alias("t_alpha"))


#: So many blocks of a replicate come from one row: what a row is exploded to waits in a task's memory, and few rows would leave most tasks without work.
_BLOCKS = 1024
#: So many weights a task counts at once.
_CELLS = 2**21


def _starts(sizes: DataFrame, replicates: int, length: int, circular: bool, seed: int) -> DataFrame:
    """(by, _n, rep, b, s, k): block b of a replicate takes k rows from rank s on; s is the first 32 bits of md5('seed-rep-b'), modulo where blocks may begin, and the last block is cut so that a replicate has n rows."""
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reps = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    some = reps.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / (length * _BLOCKS))))).repartition(parts, *sizes.columns, "rep", "_c")
    last = F.least(F.floor((F.col("_n") - 1) / length), (F.col("_c") + 1) * _BLOCKS - 1)
    starts = some.withColumn("b", F.explode(F.sequence(F.col("_c") * _BLOCKS, last))).drop("_c")
    span = F.col("_n") if circular else F.greatest(F.col("_n") - length, F.lit(1))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("rep").cast("string"), F.col("b").cast("string"))), 1, 8), 16, 10).cast("long")
    return starts.withColumns({"s": hashed % span, "k": F.least(F.lit(length), F.col("_n") - F.col("b") * length)})


def _drawn(df: DataFrame, by: list[str], replicates: int, length: int, circular: bool, seed: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their rank _i, and (by, rep, _i) of what each replicate draws."""
    order = W.partitionBy(*by).orderBy("ts")
    rows = df.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count("*").over(W.partitionBy(*by))}).where(F.col("_n") >= least)
    starts = _starts(rows.groupBy(*by).agg(F.first("_n").alias("_n")), replicates, length, circular, seed)
    drawn = starts.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).withColumn("_i", F.pmod(F.col("s") + F.col("o"), F.col("_n")).cast("int"))
    return rows.drop("_n"), drawn.select(*by, "rep", "_i")


def moment_replicates(df: DataFrame, columns: list[str], by: list[str], replicates: int = 200, length: int = 21, circular: bool = True, seed: int = 7, least: int = 50, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((by, n, mean_<c>, var_<c>) of the groups, and with rep of their block-bootstrap replicates), from running sums.

    A replicate's block is the difference of two running sums, so 2 n / length look-ups stand for n drawn rows (a third where a block
    runs over the end). Sums are of deviations from the group's mean. A variance within rounding of 0 is 0. Groups are rows
    with all columns not null, of ``least`` rows at least; ``by`` is not null. A group may be longer than a task can hold.
    """
    df = saved(df.dropna(subset=[*by, *columns]).select(*by, "ts", *columns))
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"), *(F.avg(c).alias(f"_m_{c}") for c in columns)).where(F.col("_n") >= least)
    sizes = saved(sizes)
    centred = {f"_1_{c}": F.col(c).cast("double") - F.col(f"_m_{c}") for c in columns}
    rows = df.join(sizes, by).withColumns(centred)
    rows = rows.withColumns({f"_2_{c}": F.col(f"_1_{c}") * F.col(f"_1_{c}") for c in columns})
    names = [f"_{j}_{c}" for c in columns for j in (1, 2)]
    sums = ranks.running_sums(rows.select(*by, "ts", *names), by, [F.col("ts")], names, parts)
    totals = rows.groupBy(*by).agg(F.count("*").alias("_i"), *(F.sum(c).alias(f"_s_{c}") for c in names))
    at = ["_i", *(f"_s_{c}" for c in names)]
    table = sums.select(*by, *at).unionByName(totals.select(*by, *at))
    end = F.col("s") + F.col("k")
    over = end > F.col("_n")
    ends = F.array(F.struct(F.col("s").alias("_i"), F.lit(-1.0).alias("sign")), F.struct(F.when(over, end - F.col("_n")).otherwise(end).alias("_i"), F.lit(1.0).alias("sign")), F.struct(F.when(over, F.col("_n")).alias("_i"), F.lit(1.0).alias("sign")))
    looked = _starts(sizes.select(*by, "_n"), replicates, length, circular, seed).select(*by, "rep", F.explode(ends).alias("e")).select(*by, "rep", "e.*").where("_i is not null")
    # by a shuffle: what is exploded is taken for small and would be broadcast, 2 n replicates / length rows
    reps = looked.hint("merge").join(table, [*by, "_i"]).groupBy(*by, "rep").agg(*(F.sum(F.col("sign") * F.col(f"_s_{c}")).alias(f"_s_{c}") for c in names))

    def moments(t: DataFrame, *keys: str) -> DataFrame:
        out = [F.col("_n").alias("n")]
        for c in columns:
            s1, s2 = F.col(f"_s__1_{c}"), F.col(f"_s__2_{c}")
            var = (s2 - s1 * s1 / F.col("_n")) / (F.col("_n") - 1)
            scale = F.greatest(F.col(f"_all_{c}") / F.col("_n"), F.pow(F.col(f"_m_{c}"), F.lit(2.0)))
            out += [(F.col(f"_m_{c}") + s1 / F.col("_n")).alias(f"mean_{c}"), F.when(var > 1e-13 * scale, var).otherwise(0.0).alias(f"var_{c}")]
        return t.select(*by, *keys, *out)

    sizes = sizes.join(totals.select(*by, *(F.col(f"_s__2_{c}").alias(f"_all_{c}") for c in columns)), by)
    return moments(totals.drop("_i").join(sizes, by)), moments(reps.join(sizes, by), "rep")


def moment_sharpe(c: str) -> Column:
    """``sharpe`` of a column, from its moments."""
    return F.when((F.col("n") >= 5) & (F.col(f"var_{c}") > 0), F.try_divide(F.col(f"mean_{c}"), F.sqrt(f"var_{c}")) * math.sqrt(YEAR))


def moment_bootstrap(df: DataFrame, columns: list[str], metrics: dict[str, Column], by: list[str], replicates: int = 200, length: int = 21, circular: bool = True, seed: int = 7, least: int = 50, level: float = 0.95) -> DataFrame:
    """(by, metric, value, low, high) as ``block_bootstrap`` from the same starts, for metrics of n, mean_<c> and var_<c>, by ``moment_replicates``."""
    groups, reps = moment_replicates(df, columns, by, replicates, length, circular, seed, least)
    stack = lambda d, *keys: d.select(*by, *keys, F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), m.cast("double").alias("value")) for k, m in metrics.items()))).alias("z")).select(*by, *keys, "z.*")
    tail = (1 - level) / 2
    ends = stack(reps, "rep").groupBy(*by, "metric").agg(F.percentile("value", F.lit(tail)).alias("low"), F.percentile("value", F.lit(1 - tail)).alias("high"))
    return stack(groups).join(ends, [*by, "metric"], "left")


def block_bootstrap(df: DataFrame, metrics: dict[str, Column], by: list[str], replicates: int = 200, length: int = 21, circular: bool = True, seed: int = 7, least: int = 50, level: float = 0.95) -> DataFrame:
    """(by, metric, value, low, high): percentile intervals of aggregates over block-bootstrap replicates.

    Draws are rows of their own, joined with the data by rank, so replicates spread over tasks; starts come from hashes.
    """
    rows, drawn = _drawn(df, by, replicates, length, circular, seed, least)
    sample = drawn.hint("merge").join(rows, [*by, "_i"])
    reps = sample.groupBy(*by, "rep").agg(*(m.alias(k) for k, m in metrics.items()))
    values = rows.groupBy(*by).agg(*(m.alias(k) for k, m in metrics.items()))
    stack = lambda d, *keys: d.select(*by, *keys, F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value")) for k in metrics))).alias("z")).select(*by, *keys, "z.*")
    tail = (1 - level) / 2
    ends = stack(reps, "rep").groupBy(*by, "metric").agg(F.percentile("value", F.lit(tail)).alias("low"), F.percentile("value", F.lit(1 - tail)).alias("high"))
    return stack(values).join(ends, [*by, "metric"], "left")


def _weights(rows: DataFrame, by: list[str], replicates: int, length: int, circular: bool, seed: int) -> DataFrame:
    """(by, _x, _pos, _w): how many rows of one _x and _pos each replicate draws, among ``_CELLS // replicates`` consecutive rows; _w holds unsigned integers of 1, 2, 4 or 8 bytes."""
    size = max(1, _CELLS // replicates)
    end = F.col("s") + F.col("k")
    spans = F.array(F.struct(F.col("s").alias("lo"), F.least(end, F.col("_n")).alias("hi")), F.struct(F.lit(0).cast("long").alias("lo"), (end - F.col("_n")).alias("hi")))
    drawn = _starts(rows.select(*by, "_n").distinct(), replicates, length, circular, seed).select(*by, "rep", F.explode(spans).alias("e")).select(*by, "rep", "e.*").where("hi > lo")
    touched = F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size)))
    drawn = drawn.select(*(F.col(c).alias(c) for c in by), "rep", "lo", "hi", touched.alias("_c"))  # columns other than those of rows
    own = rows.select(*by, F.floor(F.col("_i") / size).alias("_c"), (F.col("_i") % size).alias("_i"), "_x", "_pos")

    def count(key: tuple, ends: pa.Table, own: pa.Table) -> pa.Table:
        place, first = own["_i"].to_numpy(), key[-1].as_py() * size
        n = int(place.max()) + 1 if len(place) else 0
        rep = ends["rep"].to_numpy()
        lo, hi = (np.clip(ends[c].to_numpy() - first, 0, n) for c in ("lo", "hi"))
        change = np.bincount(lo * replicates + rep, minlength=(n + 1) * replicates) - np.bincount(hi * replicates + rep, minlength=(n + 1) * replicates)
        weights = change.reshape(-1, replicates).cumsum(axis=0)
        code = own["_x"].combine_chunks().dictionary_encode().indices.to_numpy() * 2 + own["_pos"].to_numpy()
        order = np.argsort(code, kind="stable")
        heads = np.flatnonzero(np.diff(code[order], prepend=-1))
        sums = np.add.reduceat(weights[place[order]], heads, axis=0) if n else weights[:0]
        sums = sums.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not n or sums.max() <= np.iinfo(t).max))
        at = np.arange(len(sums) + 1, dtype=np.int32) * (replicates * sums.itemsize)
        packed = pa.Array.from_buffers(pa.binary(), len(sums), [None, pa.py_buffer(at), pa.py_buffer(sums.tobytes())])
        return own.take(pa.array(order[heads])).select([*by, "_x", "_pos"]).append_column("_w", packed)

    out = T.StructType([*(rows.schema[c] for c in (*by, "_x", "_pos")), T.StructField("_w", T.BinaryType())])
    return drawn.groupBy(*by, "_c").cogroup(own.groupBy(*by, "_c")).applyInArrow(count, out)


def _pairs(weights: DataFrame, by: list[str], replicates: int, parts: int | None) -> DataFrame:
    """(by, _part, p, q, w) of each range of _x: arrays over replicates of the sums of positive and negative weights, and of twice the pairs that are in order within the range, ties by half."""
    n = parts or int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, "_x"]
    rows = weights.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = head = None  # the row before, and the first one of its group
        p = q = w = np.zeros(replicates, np.int64)
        tie = np.zeros((2, replicates), np.int64)  # of the last score so far, which may go on

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(head[c] for c in (*by, "_part")), *(pa.array([x]) for x in (p, q, w))], names=[*by, "_part", "p", "q", "w"])

        def add(pos: np.ndarray, neg: np.ndarray) -> None:
            nonlocal p, q, w
            below = q + neg.cumsum(axis=0) - neg
            p, q, w = p + pos.sum(axis=0), q + neg.sum(axis=0), w + (pos * (2 * below + neg)).sum(axis=0)

        for batch in batches:
            for t in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                m = t.num_rows
                new = np.zeros(m, bool)
                for c in reversed(keys):
                    group = new.copy() if c == "_x" else None
                    column = t[c] if before is None else pa.concat_arrays([before[c], t[c]])
                    differs = np.diff(column.dictionary_encode().indices.to_numpy()) != 0
                    new |= np.r_[True, differs] if before is None else differs
                    if c == "_x":
                        score, new = new, group
                if before is None:
                    new[0] = True
                score |= new
                x = np.stack([np.frombuffer(b, f"u{len(b) // replicates}").astype(np.int64) for b in t["_w"].to_pylist()])
                pos = t["_pos"].to_numpy(zero_copy_only=False)[:, None]
                heads = np.flatnonzero(score)
                cuts = heads if score[0] else np.r_[0, heads]
                sums = np.stack([np.add.reduceat(np.where(side, x, 0), cuts, axis=0) for side in (pos, ~pos)], axis=1)
                if not score[0]:
                    sums[0] += tie
                else:
                    add(tie[:1], tie[1:])
                groups = np.flatnonzero(new[cuts])
                for a, b in zip(np.r_[0, groups], np.r_[groups, len(cuts)]):
                    if a < len(cuts) and new[cuts[a]] and b > a:
                        if head is not None:
                            yield told()
                        head, p, q, w = t.slice(cuts[a], 1), *np.zeros((3, replicates), np.int64)
                    done = sums[a : b if b < len(cuts) else b - 1]
                    add(done[:, 0], done[:, 1])
                tie, before = sums[-1], t.slice(m - 1, 1)
        if head is not None:
            add(tie[:1], tie[1:])
            yield told()

    out = T.StructType([*(weights.schema[c] for c in by), T.StructField("_part", T.IntegerType()), *(T.StructField(c, T.ArrayType(T.LongType())) for c in "pqw")])
    return rows.mapInArrow(fold, out)


def auc_replicates(df: DataFrame, score: str, label: str, by: list[str], replicates: int = 500, length: int = 21, circular: bool = True, seed: int = 7, least: int = 50, parts: int | None = None) -> DataFrame:
    """(by, rep, n_pos, n_neg, auc) of block-bootstrap replicates, exactly; groups are rows with all columns not null, of ``least`` rows at least.

    A replicate is a weight a row. Weights are counted for stretches of rows from the ends of blocks, an array over replicates a row, and dealt out by ranges
    of the score, where running sums give each replicate's pairs; so n x replicates numbers are bytes of arrays and never rows. A group may be longer than a task can hold.
    """
    x = F.col(score)
    if df.schema[score].dataType in (T.DoubleType(), T.FloatType()):
        x = F.when(x == 0, F.lit(0.0).cast(df.schema[score].dataType)).otherwise(x)  # -0.0 too
    known = reduce(Column.__and__, (F.col(c).isNotNull() for c in (*by, score, label)))
    rows = ranks.numbered(df.where(known).select(*by, "ts", x.alias("_x"), (F.col(label) == 1).alias("_pos")), by, [F.col("ts")], parts)
    rows = ranks.carried(rows, by, before={"_before": ("sum", F.lit(1))}, whole={"_n": ("sum", F.lit(1))}, own={"_first": ("min", F.col("_id"))}).where(F.col("_n") >= least)
    rows = rows.withColumn("_i", F.coalesce("_before", F.lit(0)) + F.col("_id") - F.col("_first"))
    ranges = _pairs(written(_weights(rows, by, replicates, length, circular, seed)), by, replicates, parts)
    each = ranges.select(*by, "_part", F.posexplode(F.arrays_zip("p", "q", "w")).alias("rep", "z")).select(*by, "rep", "_part", "z.*")
    below = F.coalesce(F.sum("q").over(W.partitionBy(*by, "rep").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = each.withColumn("w", F.col("w") + 2 * F.col("p") * below).groupBy(*by, "rep").agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum("w").alias("w"))
    return out.select(*by, "rep", "n_pos", "n_neg", ratio(F.col("w") / 2, F.col("n_pos") * F.col("n_neg")).alias("auc"))


def auc_bootstrap(df: DataFrame, score: str, label: str, by: list[str], replicates: int = 500, length: int = 21, circular: bool = True, seed: int = 7, least: int = 50, level: float = 0.95) -> DataFrame:
    """(by, metric, value, low, high): percentile interval of the AUC, from ranks within each replicate, by ``auc_replicates``; replicates of one class are left out."""
    reps = auc_replicates(df, score, label, by, replicates, length, circular, seed, least)
    tail = (1 - level) / 2
    ends = reps.groupBy(*by).agg(F.percentile("auc", F.lit(tail)).alias("low"), F.percentile("auc", F.lit(1 - tail)).alias("high"))
    whole = ranks.auc(df, score, label, by).where(F.col("n_pos") + F.col("n_neg") >= least)
    return whole.select(*by, F.lit("auc").alias("metric"), F.col("auc").alias("value")).join(ends, by, "left")


def sharpe_difference(df: DataFrame, a: str, b: str, by: list[str], replicates: int = 200, length: int = 21, seed: int = 7) -> DataFrame:
    """(by, value, low, high, p): difference of two Sharpe ratios with the same blocks for both; p is twice the smaller share of replicates on either side of 0."""
    d = (F.coalesce(moment_sharpe(a), F.lit(0.0)) - F.coalesce(moment_sharpe(b), F.lit(0.0))).alias("d")
    groups, reps = moment_replicates(df, [a, b], by, replicates, length, True, seed, 1)
    ends = reps.select(*by, d).groupBy(*by).agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"), F.avg((F.col("d") <= 0).cast("double")).alias("_l"), F.avg((F.col("d") >= 0).cast("double")).alias("_h"))
    return groups.select(*by, d.alias("value")).join(ends, by).select(*by, "value", "low", "high", F.least(F.lit(1.0), 2 * F.least("_l", "_h")).alias("p"))


def probabilistic_sharpe(df: DataFrame, column: str, by: list[str], benchmark: float = 0.0) -> DataFrame:
    """(by, n, sr, skew, kurtosis, z): per-period Sharpe against a benchmark, corrected for skewness and raw kurtosis."""
    g = df.groupBy(*by).agg(F.count(column).alias("n"), F.try_divide(F.avg(column), F.stddev_samp(column)).alias("sr"), F.skewness(column).alias("skew"), (F.kurtosis(column) + 3).alias("kurtosis"))
    sr = F.col("sr")
    var = F.greatest(1 - F.col("skew") * sr + (F.col("kurtosis") - 1) / 4 * sr * sr, F.lit(1e-12))
    return g.withColumn("z", (sr - benchmark) * F.sqrt(F.col("n") - 1) / F.sqrt(var))


def expected_max_sharpe(variance: float, trials: int) -> float:
    """The largest per-period Sharpe that so many trials without skill are expected to show."""
    if trials < 2 or not variance > 0:
        return 0.0
    euler = 0.5772156649015329
    return math.sqrt(variance) * ((1 - euler) * normal_ppf(1 - 1 / trials) + euler * normal_ppf(1 - 1 / (trials * math.e)))


def deflated_sharpe(trials: DataFrame, column: str, by: list[str], sharpes: str = "sr") -> dict:
    """Of a table of trials' profits: {'benchmark', 'trials', 'best', 'dsr'} for the best trial, from one row a trial."""
    rows = probabilistic_sharpe(trials, column, by).where(F.col(sharpes).isNotNull()).collect()
    values = [r[sharpes] for r in rows]
    if not values:
        return {"benchmark": None, "trials": 0, "best": None, "dsr": None}
    benchmark = expected_max_sharpe(float(np.var(values, ddof=1)) if len(values) > 1 else 0.0, len(values))
    r = max(rows, key=lambda x: x[sharpes])
    var = max(1 - r["skew"] * r["sr"] + (r["kurtosis"] - 1) / 4 * r["sr"] ** 2, 1e-12)
    return {"benchmark": benchmark, "trials": len(values), "best": {k: r[k] for k in by}, "dsr": normal_cdf((r["sr"] - benchmark) * math.sqrt(r["n"] - 1) / math.sqrt(var))}


def benjamini_hochberg(df: DataFrame, p: str, by: list[str], alpha: float = 0.05) -> DataFrame:
    """df with rank, threshold, adjusted_p_raw (p n / rank), adjusted_p (monotone) and reject, within families ``by``."""
    df = df.where(F.col(p).isNotNull())
    order, family = W.partitionBy(*by).orderBy(p, *(c for c in df.columns if c not in by and c != p)), W.partitionBy(*by)
    df = df.withColumns({"rank": F.row_number().over(order), "_n": F.count("*").over(family)})
    df = df.withColumns({"threshold": alpha * F.col("rank") / F.col("_n"), "adjusted_p_raw": F.least(F.lit(1.0), F.col(p) * F.col("_n") / F.col("rank"))})
    later = W.partitionBy(*by).orderBy("rank").rowsBetween(0, W.unboundedFollowing)
    last = F.max(F.when(F.col(p) <= F.col("threshold"), F.col("rank"))).over(family)
    return df.withColumns({"adjusted_p": F.min("adjusted_p_raw").over(later), "reject": F.coalesce(F.col("rank") <= last, F.lit(False))}).drop("_n")
