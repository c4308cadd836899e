"""Walk-forward long/short backtests, all parameter combinations in one job.

Folds of ``refit`` dates begin at date number ``train``. At a fold's start the basket is chosen from the signal of the date
before, and tau is a quantile of the efficiency of the ``train`` dates before. On a date of the fold the basket is held if
efficiency is under tau. The profit of a date is yesterday's weights times today's returns, less cost times the change of weights
that the date decides; a date without efficiency keeps its position and has profit 0. Folds with under ``enough``
efficiencies to learn from have null profit and keep the position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftwell.operators.aggregates import top_bottom
from driftwell.operators.rolling import YEAR


def calendar(panel: DataFrame) -> DataFrame:
    """(ts, day) with day from 0. The window holds one row a date, however many series there are."""
    return panel.select("ts").distinct().withColumn("day", F.row_number().over(W.partitionBy().orderBy("ts")) - 1)


def folds(days: DataFrame, efficiency: DataFrame, train: int, configs: list[dict], shares: list[float], enough: int = 50) -> DataFrame:
    """(ts, day, eff, config, signal, refit, conditional, fold, tau): tau is null in folds that cannot learn. efficiency: (ts, eff); quantiles are taken once a date, of all shares."""
    frame = W.partitionBy().orderBy("day").rowsBetween(-train, -1)
    past = F.when(F.count("eff").over(frame) >= enough, F.percentile("eff", F.array(*map(F.lit, shares))).over(frame))
    d = days.join(efficiency, "ts", "left").withColumn("_past", past).where(F.col("day") >= train)
    d = d.withColumn("_c", F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in c.items())) for c in configs)))).select(*d.columns, "_c.*")
    d = d.withColumn("fold", F.floor((F.col("day") - train) / F.col("refit")))
    first = F.when(F.col("day") == F.col("fold") * F.col("refit") + train, F.get("_past", F.col("share_at")))
    return d.withColumn("tau", F.max(first).over(W.partitionBy("config", "fold"))).drop("_past")


def _walked(panel: DataFrame, efficiency: DataFrame, configs: list[tuple[str, int, float, bool]], train: int, top: float, enough: int) -> DataFrame:
    """walk_forward of (signal, refit, share, conditional) combinations, with ``config`` their number; panel: (series_id, ts, ret) and the signals."""
    shares, signals = sorted({c[2] for c in configs}), sorted({c[0] for c in configs})
    table = [{"config": k, "signal": s, "refit": r, "conditional": c, "share_at": shares.index(x)} for k, (s, r, x, c) in enumerate(configs)]
    days = calendar(panel)
    plan = folds(days, efficiency, train, table, shares, enough)
    learned = F.col("tau").isNotNull() & F.col("eff").isNotNull()
    plan = plan.withColumn("deploy", F.when(~F.col("conditional"), F.lit(1)).when(learned, (F.col("eff") < F.col("tau")).cast("int")))
    starts = plan.groupBy("config", "signal", "fold").agg((F.min("day") - 1).alias("day"))
    dated = panel.join(days, "ts").select("series_id", "day", F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("score")) for s in signals))).alias("s")).select("series_id", "day", "s.*")
    basket = top_bottom(dated.join(F.broadcast(starts), ["day", "signal"]), ["config", "fold"], "score", top)  # a row each fold
    sizes = basket.groupBy("config", "fold", "side").agg(F.count("*").alias("n_side"))
    basket = basket.join(sizes, ["config", "fold", "side"]).select("config", "fold", "series_id", (F.col("side") / F.col("n_side")).alias("target"))
    # decision dates only: the position after each of them, for assets in its basket or in the one before
    decisions = plan.where("deploy is not null").withColumn("k", F.row_number().over(W.partitionBy("config").orderBy("day")))
    held = decisions.join(basket, ["config", "fold"]).select("config", "k", "day", "series_id", (F.col("target") * F.col("deploy")).alias("weight")).where("weight <> 0")
    ahead = held.select("config", (F.col("k") + 1).alias("k"), "series_id", F.col("weight").alias("old"))
    change = held.select("config", "k", "series_id", "weight").join(ahead, ["config", "k", "series_id"], "full")
    turnover = change.groupBy("config", "k").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("turnover"))
    # a position is held on the dates after its decision up to the next one
    before = W.partitionBy("config").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    of_day = plan.select("config", "ts", "day", "fold", "deploy", "tau", "conditional").withColumn("k_held", F.sum(F.coalesce(F.col("deploy") * 0 + 1, F.lit(0))).over(before))
    earned = of_day.where("k_held > 0").select("config", "ts", "day", "k_held").join(held.select("config", F.col("k").alias("k_held"), "series_id", "weight"), ["config", "k_held"])
    gross = earned.join(panel.select("ts", "series_id", "ret"), ["ts", "series_id"], "left").groupBy("config", "day").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("gross"))
    out = of_day.join(gross, ["config", "day"], "left").join(decisions.select("config", "day", "k").join(turnover, ["config", "k"], "left").drop("k"), ["config", "day"], "left")
    live, skipped = F.col("deploy").isNotNull(), F.col("conditional") & F.col("tau").isNull()
    return out.select(
        "config", "ts", "day", "fold",
        F.when(~skipped, F.when(live, F.coalesce("gross", F.lit(0.0))).otherwise(0.0)).alias("gross"),
        F.when(~skipped, F.when(live, F.coalesce("turnover", F.lit(0.0))).otherwise(0.0)).alias("turnover"),
        F.coalesce("deploy", F.lit(0)).alias("deployed"),
    )


def walk_forward(
    panel: DataFrame, efficiency: DataFrame, signal: str = "score", train: int = 252, refit: int = 21, share: float = 0.4, top: float = 0.2, enough: int = 50, conditional: bool = True
) -> DataFrame:
    """(ts, day, fold, gross, turnover, deployed): gross and turnover do not depend on cost, so every cost is one projection of them.

    panel: (series_id, ts, ret, signal); efficiency: (ts, eff). Without ``conditional`` the basket is held on every date.
    """
    return _walked(panel, efficiency, [(signal, refit, share, conditional)], train, top, enough).drop("config")


def grid(
    panels: dict[int, str], panel: DataFrame, efficiency: DataFrame, refits: list[int], shares: list[float], train: int = 252, top: float = 0.2, enough: int = 50, arms: tuple[bool, ...] = (True,)
) -> DataFrame:
    """walk_forward of every combination in one plan: ``panels`` names the signal column of each momentum length, ``arms`` says whether the basket waits for the condition; columns mom, refit, share and conditional."""
    chosen = [(mom, signal, refit, share, arm) for mom, signal in panels.items() for refit in refits for share in shares for arm in arms]
    runs = _walked(panel, efficiency, [c[1:] for c in chosen], train, top, enough)
    names = panel.sparkSession.createDataFrame([(k, c[0], *c[2:]) for k, c in enumerate(chosen)], "config int, mom int, refit int, share double, conditional boolean")
    return runs.join(F.broadcast(names), "config").drop("config")  # a row a combination


def net(df: DataFrame, cost: float) -> DataFrame:
    return df.withColumn("pnl", F.col("gross") - cost * F.col("turnover"))


def costs(df: DataFrame, levels: list[float]) -> DataFrame:
    """Each row once for each cost, with its profit."""
    df = df.withColumn("cost", F.explode(F.array(*map(F.lit, levels))))
    return df.withColumn("pnl", F.col("gross") - F.col("cost") * F.col("turnover"))


def performance(df: DataFrame, by: list[str], pnl: str = "pnl") -> DataFrame:
    """n, annual return, volatility and Sharpe, t against 0, max drawdown of compounded wealth, share of active days, win rate on them."""
    df = df.where(F.col(pnl).isNotNull())
    frame = W.partitionBy(*by).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("_w", F.exp(F.sum(F.log1p(F.greatest(F.col(pnl), F.lit(-0.999999)))).over(frame)))
    df = df.withColumn("_dd", F.try_divide(F.col("_w"), F.greatest(F.max("_w").over(frame), F.lit(1.0))) - 1)
    x = F.col(pnl)
    g = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.min("_dd").alias("max_drawdown"),
        F.avg((x != 0).cast("double")).alias("active"), F.avg(F.when(x != 0, (x > 0).cast("double"))).alias("win_rate"),
    )
    ok = (F.col("n") >= 5) & (F.col("s") > 0)
    return g.select(
        *by, "n", (F.col("m") * YEAR).alias("ann_return"), (F.col("s") * YEAR**0.5).alias("ann_vol"), F.when(ok, F.try_divide(F.col("m"), F.col("s")) * YEAR**0.5).alias("sharpe"),
        F.when(ok, F.try_divide(F.col("m") * F.sqrt("n"), F.col("s"))).alias("t_stat"), "max_drawdown", "active", "win_rate",
    )


def active_performance(df: DataFrame, by: list[str], pnl: str = "pnl", least: int = 30) -> DataFrame:
    """Of days with a profit other than 0, where there are ``least``: Sharpe, Sortino, Calmar over the summed drawdown, skew and kurtosis."""
    x = F.col(pnl)
    df = df.where(x.isNotNull() & (x != 0))
    frame = W.partitionBy(*by).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("_c", F.sum(x).over(frame))
    df = df.withColumn("_dd", F.col("_c") - F.max("_c").over(frame))
    g = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.stddev_samp(F.when(x < 0, x)).alias("d"), F.min("_dd").alias("dd"),
        F.skewness(x).alias("skew"), (F.kurtosis(x)).alias("excess_kurtosis"),
    ).where(F.col("n") >= least)
    year = YEAR**0.5
    return g.select(
        *by, "n", (F.try_divide("m", "s") * year).alias("sharpe"), (F.try_divide("m", "d") * year).alias("sortino"),
        F.try_divide(F.col("m") * YEAR, F.abs("dd")).alias("calmar"), F.col("dd").alias("max_drawdown"), "skew", "excess_kurtosis",
    )


def by_regime(df: DataFrame, regime: str, by: list[str], pnl: str = "pnl") -> DataFrame:
    """Performance in each regime, and the regime's share of the days."""
    g = performance(df, [*by, regime], pnl)
    return g.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def baselines(panel: DataFrame, n: int = 20, top: float = 0.2) -> DataFrame:
    """(ts, momentum, reversion, hold): the long/short return of the best and worst assets of the n rows before, its negative, and the equal-weight market."""
    by = W.partitionBy("series_id").orderBy("ts")
    df = panel.withColumn("_past", F.when(F.count("ret").over(by.rowsBetween(-n, -1)) >= n, F.sum("ret").over(by.rowsBetween(-n, -1))))
    sides = top_bottom(df.select("ts", "series_id", "_past"), ["ts"], "_past", top)
    legs = sides.join(df.select("ts", "series_id", "ret"), ["ts", "series_id"]).groupBy("ts").agg(
        (F.avg(F.when(F.col("side") == 1, F.col("ret"))) - F.avg(F.when(F.col("side") == -1, F.col("ret")))).alias("spread")
    )
    hold = panel.groupBy("ts").agg(F.avg("ret").alias("hold"))
    return hold.join(legs, "ts", "left").select("ts", (F.col("spread") * 0.5).alias("momentum"), (-F.col("spread") * 0.5).alias("reversion"), "hold")
