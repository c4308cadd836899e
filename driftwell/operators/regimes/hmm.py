"""Gaussian hidden Markov models of many series.

Fits are independent by series, number of states and restart, so each (series, states) is a group and restarts are a vector axis
inside it. Filtering under given parameters also runs on blocks of long series: a block's summary is the K x K matrix of its
forward pass from each state, summaries are composed in order, and blocks are replayed from their carry.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.operators.blocks import numbered, saved, spread

FLOOR = 1e-3
PARAMETERS = "k int, pi array<double>, a array<double>, mu array<double>, sd array<double>, loglik double, bic double, n long, converged boolean"


def densities(x: np.ndarray, mu: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Log normal densities: time by (restart by) state."""
    x = x.reshape(-1, *([1] * mu.ndim))
    return -0.5 * ((x - mu) / sd) ** 2 - np.log(sd) - 0.9189385332046727


def _in_blocks(b: np.ndarray, front: bool = False) -> np.ndarray:
    """(T, ..., K) as blocks of about sqrt(T) rows: place in block, block, ..., K. Rows of 1 fill them up behind the last row, or before the first, where nothing that matters comes from them."""
    size = math.isqrt(max(len(b) - 1, 0)) + 1
    count = -(-len(b) // size)
    fill = np.ones((count * size - len(b), *b.shape[1:]))
    padded = np.concatenate([fill, b] if front else [b, fill])
    return np.swapaxes(padded.reshape(count, size, *b.shape[1:]), 0, 1)


def _maps(blocks: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Each block's matrix, up to a factor: the state before a block to the state before the next."""
    m = blocks[0][..., :, None] * a
    for b in blocks[1:]:
        m = (m * b[..., None, :]) @ a
        m /= m.max((-1, -2), keepdims=True)
    return m


def _left(now: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (now[..., None, :] @ m)[..., 0, :]


def _right(m: np.ndarray, now: np.ndarray) -> np.ndarray:
    return (m @ now[..., None])[..., 0]


def forward(logb: np.ndarray, pi: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filtered probabilities and log predictive densities of (T, ..., K) log densities.

    All blocks of rows move at once: a block's matrix, carries over blocks, and blocks from their carries.
    """
    top = logb.max(-1)
    blocks = _in_blocks(np.exp(logb - top[..., None]))
    maps = _maps(blocks, a)
    carry, now = np.empty(blocks.shape[1:]), pi
    for k in range(len(carry)):
        carry[k] = now
        now = _left(now, maps[k])
        now = now / now.sum(-1, keepdims=True)
    out, scale = np.empty_like(blocks), np.empty(blocks.shape[:-1])
    now = carry
    for t in range(len(blocks)):
        now = now * blocks[t]
        total = now.sum(-1)
        scale[t] = total
        out[t] = now = now / total[..., None]
        now = _left(now, a)
    whole = lambda x: np.swapaxes(x, 0, 1).reshape(-1, *x.shape[2:])[: len(logb)]
    return whole(out), np.log(whole(scale)) + top


def backward(logb: np.ndarray, a: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """Backward variables, each scaled to a sum of 1. ``after`` is that of the row behind the last, times its densities, if there is one."""
    blocks = _in_blocks(np.exp(logb - logb.max(-1, keepdims=True)), front=True)
    maps = _maps(blocks, a)
    ends, now = np.empty(blocks.shape[1:]), np.full(blocks.shape[2:], 1 / blocks.shape[-1]) if after is None else after
    for k in range(len(ends) - 1, -1, -1):  # of the row behind a block
        ends[k] = now
        now = _right(maps[k], now)
        now = now / now.sum(-1, keepdims=True)
    out, now = np.empty_like(blocks), ends
    for t in range(len(blocks) - 1, -1, -1):
        now = _right(a, now)
        out[t] = now = now / now.sum(-1, keepdims=True)
        now = now * blocks[t]
    out = np.swapaxes(out, 0, 1).reshape(-1, *out.shape[2:])
    return out[len(out) - len(logb) :]


def starts(centre: float, spread: float, k: int, restarts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First pi, a, mu and sd of each restart: states apart in scale, seldom left."""
    rng = np.random.default_rng(k)
    base = np.linspace(-1, 1, k) if k > 1 else np.zeros(1)
    sd = spread * np.exp(base[None, :] * np.linspace(0.5, 1.5, restarts)[:, None])
    mu = centre + 0.1 * spread * rng.standard_normal((restarts, k))
    a = np.broadcast_to(np.where(np.eye(k) > 0, 0.95 if k > 1 else 1.0, 0.05 / max(k - 1, 1)), (restarts, k, k)).copy()
    return np.full((restarts, k), 1 / k), a, mu, sd


def fit(x: np.ndarray, k: int, restarts: int = 4, most: int = 100, tolerance: float = 1e-6) -> dict:
    """Baum-Welch from ``restarts`` starts spread in scale; the best of them, states ordered by deviation. ``converged`` tells whether that one settled within ``most`` rounds.

    A restart that has settled takes no part in later rounds.
    """
    n, spread = len(x), max(float(x.std()), FLOOR)
    pi, a, mu, sd = starts(x.mean(), spread, k, restarts)
    last, settled = np.full(restarts, -np.inf), np.zeros(restarts, bool)
    for _ in range(most):
        on = np.flatnonzero(~settled)
        logb = densities(x, mu[on], sd[on])
        b = np.exp(logb - logb.max(-1, keepdims=True))
        alpha, ll = forward(logb, pi[on], a[on])
        total = ll.sum(0)
        stop = total - last[on] < tolerance * np.abs(total)
        last[on], settled[on[stop]] = total, True
        if stop.all():
            break
        # restarts that have settled keep what they have
        go = ~stop
        on, logb, b, alpha = on[go], logb[:, go], b[:, go], alpha[:, go]
        beta = backward(logb, a[on])
        gamma = alpha * beta
        gamma /= gamma.sum(-1, keepdims=True)
        ahead = b[1:] * beta[1:]
        xi = alpha[:-1, ..., :, None] * a[on] * ahead[..., None, :]
        xi = (xi / xi.sum((-1, -2), keepdims=True)).sum(0)
        weight = np.maximum(gamma.sum(0), 1e-10)
        a[on] = (xi + 1e-10) / (xi + 1e-10).sum(-1, keepdims=True)
        pi[on] = gamma[0]
        mu[on] = np.einsum("trk,t->rk", gamma, x) / weight
        sd[on] = np.sqrt(np.maximum((gamma * (x[:, None, None] - mu[on]) ** 2).sum(0) / weight, (FLOOR * spread) ** 2))
    total = forward(densities(x, mu, sd), pi, a)[1].sum(0)
    r = int(np.argmax(total))
    o = np.argsort(sd[r], kind="stable")
    p = (k - 1) + k * (k - 1) + 2 * k
    return {"k": k, "pi": pi[r][o], "a": a[r][np.ix_(o, o)].ravel(), "mu": mu[r][o], "sd": sd[r][o], "loglik": float(total[r]), "bic": float(-2 * total[r] + p * np.log(n)), "n": n, "converged": bool(settled[r])}


def fitted(df: DataFrame, column: str = "ret", by: tuple[str, ...] = ("series_id",), states: tuple[int, ...] = (2,), restarts: int = 4, least: int = 30, most: int = 100) -> DataFrame:
    """(by, k, pi, a (row by row), mu, sd, loglik, bic, n, converged) for each number of states; series of under ``least`` values are left out."""
    kinds = dict(df.dtypes)
    rows = df.where(F.col(column).isNotNull()).select(*by, "ts", F.col(column).alias("x"))
    rows = rows.withColumn("states", F.explode(F.array(*map(F.lit, states))))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        if len(p) < least:
            return pd.DataFrame(columns=[*by, *(c.split()[0] for c in PARAMETERS.split(", "))])
        p = p.sort_values("ts")
        got = fit(p["x"].to_numpy(float), int(p["states"].iloc[0]), restarts, most)
        return pd.DataFrame([{**{c: p[c].iloc[0] for c in by}, **{k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in got.items()}}])

    return spread(rows, *by, "states").groupBy(*by, "states").applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), PARAMETERS]))


def labelled(df: DataFrame, parameters: DataFrame, column: str = "ret", by: tuple[str, ...] = ("series_id",), smooth: bool = False) -> DataFrame:
    """(by, ts, p_high, label, log_score): the probability of the state of largest deviation, filtered or smoothed, and the log predictive density of each row."""
    kinds = dict(df.dtypes)
    rows = df.where(F.col(column).isNotNull()).select(*by, "ts", F.col(column).alias("x"))

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame(columns=[*by, "ts", "p_high", "label", "log_score"])
        p, m = p.sort_values("ts"), q.iloc[0]
        k = int(m["k"])
        logb, a = densities(p["x"].to_numpy(float), np.array(m["mu"]), np.array(m["sd"])), np.array(m["a"]).reshape(k, k)
        state, ll = forward(logb, np.array(m["pi"]), a)
        if smooth:
            state = state * backward(logb, a)
            state /= state.sum(-1, keepdims=True)
        return pd.DataFrame({**{c: p[c] for c in by}, "ts": p["ts"], "p_high": state[:, -1], "label": (state.argmax(1) == k - 1).astype(np.int32), "log_score": ll})

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), f"ts {kinds['ts']}", "p_high double, label int, log_score double"])
    return rows.groupBy(*by).cogroup(parameters.withColumns({f"_by_{c}": F.col(c) for c in by}).groupBy(*(f"_by_{c}" for c in by))).applyInPandas(run, schema)


def block_filter(df: DataFrame, parameters: DataFrame, column: str = "ret", size: int = 4096) -> DataFrame:
    """(series_id, ts, p_high, log_score) as ``labelled`` gives, with blocks of ``size`` rows as tasks: for series too long for one."""
    kinds = dict(df.dtypes)
    series = kinds["series_id"]
    rows = numbered(df.where(F.col(column).isNotNull()).select("series_id", "ts", F.col(column).alias("x")), size)
    rows = saved(rows.join(parameters.select("series_id", "k", "pi", "a", "mu", "sd"), "series_id"))

    def matrices(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        m = p.iloc[0]
        k = int(m["k"])
        return densities(p["x"].to_numpy(float), np.array(m["mu"]), np.array(m["sd"])), np.array(m["a"]).reshape(k, k)

    def summary(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rn")
        logb, a = matrices(p)
        k = a.shape[0]
        b = np.exp(logb - logb.max(1, keepdims=True))
        m = np.eye(k)
        for t in range(len(b)):  # state before a row -> state before the next
            m = (m * b[t]) @ a
            m /= m.max()
        return pd.DataFrame({"series_id": [p["series_id"].iloc[0]], "block": [p["block"].iloc[0]], "m": [m.ravel().tolist()], "pi": [list(p["pi"].iloc[0])]})

    maps = rows.groupBy("series_id", "block").applyInPandas(summary, f"series_id {series}, block long, m array<double>, pi array<double>")

    def carried(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("block")
        now, out = np.array(p["pi"].iloc[0], float), []
        for m in p["m"]:
            out.append(now.tolist())
            now = now @ np.array(m).reshape(len(now), -1)
            now = now / now.sum()
        return pd.DataFrame({"series_id": p["series_id"], "block": p["block"], "carry": out})

    carries = maps.groupBy("series_id").applyInPandas(carried, f"series_id {series}, block long, carry array<double>")

    def replay(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rn")
        logb, a = matrices(p)
        state, ll = forward(logb, np.array(p["carry"].iloc[0]), a)
        return pd.DataFrame({"series_id": p["series_id"], "ts": p["ts"], "p_high": state[:, -1], "log_score": ll})

    return rows.join(carries, ["series_id", "block"]).groupBy("series_id", "block").applyInPandas(replay, f"series_id {series}, ts {kinds['ts']}, p_high double, log_score double")


def block_fitted(df: DataFrame, column: str = "ret", states: tuple[int, ...] = (2,), restarts: int = 1, rounds: int = 100, tolerance: float = 1e-6, size: int = 4096) -> DataFrame:
    """(series_id, k, pi, a, mu, sd, loglik, bic, n, converged) as ``fitted`` gives, with blocks of ``size`` rows as tasks.

    A round of Baum-Welch is one job over all (series, states, restart) that have not settled: a block's matrix; forward and backward carries of its
    series, one row a block; and the block's expected counts, summed by series. The likelihood of what has not settled in ``rounds`` rounds is that before the last one.
    """
    series = dict(df.dtypes)["series_id"]
    rows = saved(numbered(df.where(F.col(column).isNotNull()).select("series_id", "ts", F.col(column).cast("double").alias("x")), size))
    stats = rows.groupBy("series_id").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("*").alias("n"))
    blocks = rows.groupBy("series_id", "block").agg(F.sort_array(F.collect_list(F.struct("rn", "x"))).alias("xs"))
    ends = stats.select("series_id", F.floor((F.col("n") - 1) / size).alias("end"))
    blocks = saved(blocks.join(ends, "series_id").select("series_id", "block", F.col("xs.x").alias("xs"), (F.col("block") == F.col("end")).alias("last")))

    key = ["series_id", "k", "start"]
    kind = f"series_id {series}, k int, start int"
    model = f"{kind}, pi array<double>, a array<double>, mu array<double>, sd array<double>, spread double, loglik double, n long, settled boolean"
    columns = lambda schema: [c.split()[0] for c in schema.split(", ")]
    given = ["pi", "a", "mu", "sd"]

    def first(frames):
        for p in frames:
            out = []
            for r in p.itertuples():
                spread = max(float(r.s), FLOOR)
                for k in states:
                    out += [(r.series_id, k, i, pi.tolist(), a.ravel().tolist(), mu.tolist(), sd.tolist(), spread, float("-inf"), r.n, False) for i, (pi, a, mu, sd) in enumerate(zip(*starts(r.m, spread, k, restarts)))]
            yield pd.DataFrame(out, columns=columns(model))

    def parts(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.asarray(r.xs, float)
        return x, densities(x, np.asarray(r.mu, float), np.asarray(r.sd, float)), np.asarray(r.a, float).reshape(r.k, r.k)

    def summary(frames):
        for p in frames:
            out = []
            for r in p.itertuples():
                _, logb, a = parts(r)
                inner = _maps(_in_blocks(np.exp(logb - logb.max(1, keepdims=True)), front=True), a)
                # rows that fill up the first inner block come before all, and would move the state: that block is made of its own rows
                size_ = math.isqrt(max(len(logb) - 1, 0)) + 1
                own = len(logb) - size_ * (len(inner) - 1)
                inner[0] = _maps(np.exp(logb[:own] - logb[:own].max(1, keepdims=True))[:, None], a)[0]
                m = inner[0]
                for other in inner[1:]:
                    m = m @ other
                    m /= m.max()
                out.append((r.series_id, r.k, r.start, r.block, m.ravel().tolist(), r.pi))
            yield pd.DataFrame(out, columns=[*key, "block", "m", "pi"])

    def carried(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("block")
        k = int(p["k"].iloc[0])
        ms = [np.array(m).reshape(k, k) for m in p["m"]]
        before, now = [], np.array(p["pi"].iloc[0], float)
        for m in ms:
            before.append(now.tolist())
            now = now @ m
            now /= now.sum()
        after, now = [], np.ones(k) / k
        for m in ms[::-1]:
            after.append(now.tolist())
            now = m @ now
            now /= now.sum()
        return p[[*key, "block"]].assign(before=before, after=after[::-1])

    sums = f"{kind}, block long, w array<double>, wx array<double>, wxx array<double>, xi array<double>, first array<double>, ll double"

    def expected(frames):
        for p in frames:
            out = []
            for r in p.itertuples():
                x, logb, a = parts(r)
                after = np.asarray(r.after, float)
                alpha, ll = forward(logb, np.asarray(r.before, float), a)
                beta = backward(logb, a, after)
                gamma = alpha * beta
                gamma /= gamma.sum(1, keepdims=True)
                ahead = np.concatenate([(np.exp(logb - logb.max(1, keepdims=True)) * beta)[1:], np.zeros((0, len(after))) if r.last else after[None]])
                joint = alpha[: len(ahead), :, None] * a * ahead[:, None, :]
                xi = (joint / joint.sum((1, 2), keepdims=True)).sum(0)
                out.append((r.series_id, r.k, r.start, r.block, gamma.sum(0).tolist(), (gamma * x[:, None]).sum(0).tolist(), (gamma * (x[:, None] - np.asarray(r.mu)) ** 2).sum(0).tolist(), xi.ravel().tolist(), gamma[0].tolist(), float(ll.sum())))
            yield pd.DataFrame(out, columns=columns(sums))

    def maximised(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        old, p = q.iloc[0].to_dict(), p.sort_values("block")
        k, total = int(old["k"]), float(p["ll"].sum())
        old["settled"], old["loglik"] = bool(total - old["loglik"] < tolerance * abs(total)), total
        if not old["settled"]:
            w, wx, wd, xi = (np.sum(np.array(p[c].tolist()), axis=0) for c in ("w", "wx", "wxx", "xi"))
            w = np.maximum(w, 1e-10)
            mu, xi = wx / w, xi.reshape(k, k) + 1e-10
            var = np.maximum(wd / w - (mu - np.array(old["mu"])) ** 2, (FLOOR * old["spread"]) ** 2)
            old["pi"], old["a"], old["mu"], old["sd"] = list(p["first"].iloc[0]), (xi / xi.sum(1, keepdims=True)).ravel().tolist(), mu.tolist(), np.sqrt(var).tolist()
        return pd.DataFrame([[old[c] for c in columns(model)]], columns=columns(model))

    open_, done = saved(stats.mapInPandas(first, model)), []
    for _ in range(rounds):
        now = blocks.join(open_.select(*key, *given), "series_id")
        maps = now.mapInPandas(summary, f"{kind}, block long, m array<double>, pi array<double>")
        carries = maps.groupBy(*key).applyInPandas(carried, f"{kind}, block long, before array<double>, after array<double>")
        told = now.join(carries, [*key, "block"]).mapInPandas(expected, sums)
        old = open_.select(*(F.col(c).alias(f"_{c}") for c in key), *open_.columns)
        after = saved(told.groupBy(*key).cogroup(old.groupBy(*(f"_{c}" for c in key))).applyInPandas(maximised, model))
        done.append(after.where("settled"))
        open_ = after.where("not settled")
        if open_.isEmpty():
            break

    def ordered(frames):
        for p in frames:
            out = []
            for r in p.itertuples():
                o = np.argsort(np.asarray(r.sd), kind="stable")
                free = (r.k - 1) + r.k * (r.k - 1) + 2 * r.k
                a = np.asarray(r.a).reshape(r.k, r.k)[np.ix_(o, o)].ravel().tolist()
                out.append((r.series_id, r.k, np.asarray(r.pi)[o].tolist(), a, np.asarray(r.mu)[o].tolist(), np.asarray(r.sd)[o].tolist(), r.loglik, -2 * r.loglik + free * math.log(r.n), r.n, r.settled))
            yield pd.DataFrame(out, columns=["series_id", *columns(PARAMETERS)])

    names = [c for c in columns(model) if c not in ("series_id", "k", "loglik")]
    best = reduce(DataFrame.unionByName, [*done, open_]).groupBy("series_id", "k").agg(F.max(F.struct("loglik", *names)).alias("b")).select("series_id", "k", "b.*")
    return best.mapInPandas(ordered, f"series_id {series}, {PARAMETERS}")


def parameter_table(parameters: DataFrame, periods: int = 252) -> DataFrame:
    """(series_id, k, state, ann_mean, ann_vol, duration, share) of each state; the share is that of the stationary chain of two states, null for more."""
    rows = parameters.select("series_id", "k", "a", F.posexplode("mu").alias("state", "mu"), "sd")
    stay = F.get("a", F.col("state") * F.col("k") + F.col("state"))
    leave = lambda i: 1 - F.get("a", F.lit(i) * F.col("k") + F.lit(i))
    share = F.when(F.col("k") == 2, F.try_divide(F.when(F.col("state") == 0, leave(1)).otherwise(leave(0)), leave(0) + leave(1)))
    return rows.select("series_id", "k", "state", (F.col("mu") * periods).alias("ann_mean"), (F.get("sd", F.col("state")) * periods**0.5).alias("ann_vol"), F.try_divide(F.lit(1.0), 1 - stay).alias("duration"), share.alias("share"))


def yearly(df: DataFrame, column: str = "ret", k: int = 2, first: int = 100, restarts: int = 2) -> DataFrame:
    """(series_id, ts, year, p_high, label): each year's rows by the filter of a model fitted on all rows before that year, if there are ``first``.

    A row is a training row of every later year, so (series, year) are independent groups.
    """
    rows = df.where(F.col(column).isNotNull()).select("series_id", "ts", F.col(column).cast("double").alias("x"), F.year("ts").alias("own"))
    last = rows.groupBy("series_id").agg(F.max("own").alias("last"))
    rows = rows.join(last, "series_id").withColumn("year", F.explode(F.sequence("own", "last"))).drop("last")
    kinds = dict(df.dtypes)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ts")
        old = (p["own"] < p["year"]).to_numpy()
        if old.sum() < first or old.all():
            return pd.DataFrame(columns=["series_id", "ts", "year", "p_high", "label"])
        x = p["x"].to_numpy(float)
        m = fit(x[old], k, restarts)
        state, _ = forward(densities(x, m["mu"], m["sd"]), m["pi"], m["a"].reshape(k, k))
        new = p[~old]
        return pd.DataFrame({"series_id": new["series_id"], "ts": new["ts"], "year": new["year"], "p_high": state[~old][:, -1], "label": (state[~old].argmax(1) == k - 1).astype(np.int32)})

    return spread(rows, "series_id", "year").groupBy("series_id", "year").applyInPandas(run, f"series_id {kinds['series_id']}, ts {kinds['ts']}, year int, p_high double, label int")
