"""Statistical jump models: states are centroids of causal features, and a change of state costs a penalty.

Labels under given centroids also run on blocks of long series: costs from each state before a block to each state at its end are a matrix, and
matrices compose by sums and minima. Forward carries give each block its costs at the start, hence the online labels and, for each label at its end, the label before
it; these maps compose backwards to the label that each block ends with.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.operators.blocks import decayed, numbered, saved, spread

FEATURES = [f"{f}{h}" for h in (5, 10, 21) for f in ("mean", "down", "sortino")]


def features(df: DataFrame, column: str = "ret", n_fit: int = 10**9, clip: float = 5.0) -> DataFrame:
    """(series_id, ts, nine features): for half-lives 5, 10 and 21 the weighted mean, log downside deviation and their ratio, standardised on a series' first n_fit rows and clipped."""
    kinds = dict(df.dtypes)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ts")
        out, x = {"series_id": p["series_id"], "ts": p["ts"]}, p["x"].reset_index(drop=True)
        for h in (5, 10, 21):
            mean = x.ewm(halflife=h).mean()
            down = np.sqrt((x.clip(upper=0) ** 2).ewm(halflife=h).mean()).clip(lower=1e-8)
            for name, v in (("mean", mean), ("down", np.log(down)), ("sortino", mean / down)):
                own = v.iloc[:n_fit]
                sd = own.std(ddof=0)
                out[f"{name}{h}"] = ((v - own.mean()) / (sd if sd > 1e-12 else 1.0)).clip(-clip, clip).to_numpy()
        return pd.DataFrame(out)

    schema = f"series_id {kinds['series_id']}, ts {kinds['ts']}, " + ", ".join(f"{c} double" for c in FEATURES)
    return df.where(F.col(column).isNotNull()).select("series_id", "ts", F.col(column).cast("double").alias("x")).groupBy("series_id").applyInPandas(run, schema)


def path(loss: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """The labels of least loss plus penalty a change, the lower state of equals."""
    n, k = loss.shape
    value, back = loss[0].copy(), np.zeros((n, k), np.int8)
    for t in range(1, n):
        best = int(np.argmin(value))
        change = value[best] + penalty
        back[t] = np.where(value <= change, np.arange(k), best)
        value = np.minimum(value, change) + loss[t]
    labels = np.empty(n, np.int32)
    labels[-1] = int(np.argmin(value))
    for t in range(n - 1, 0, -1):
        labels[t - 1] = back[t][labels[t]]
    return labels, float(value.min())


def online(loss: np.ndarray, penalty: float) -> np.ndarray:
    """The state of least value at each row, from the rows up to it."""
    value, out = loss[0].copy(), np.empty(len(loss), np.int32)
    out[0] = int(np.argmin(value))
    for t in range(1, len(loss)):
        value = np.minimum(value, value.min() + penalty) + loss[t]
        out[t] = int(np.argmin(value))
    return out


def centroids(x: np.ndarray, penalty: float, k: int = 2, restarts: int = 5, most: int = 30) -> tuple[np.ndarray, float]:
    """Alternates labels and means from ``restarts`` starts; the best, ordered by the downside feature."""
    rng, best, low = np.random.default_rng(k), None, np.inf
    for _ in range(restarts):
        c = x[rng.choice(len(x), k, replace=False)]
        last = np.inf
        for _ in range(most):
            loss = 0.5 * ((x[:, None, :] - c[None]) ** 2).sum(-1)
            labels, value = path(loss, penalty)
            c = np.array([x[labels == j].mean(0) if (labels == j).any() else c[j] for j in range(k)])
            if last - value < 1e-9 * max(1.0, abs(value)):
                break
            last = value
        if value < low:
            best, low = c, value
    return best[np.argsort(best[:, 1], kind="stable")], low


def labelled(feats: DataFrame, penalties: tuple[float, ...] = (10.0, 30.0, 100.0), fit_share: float = 1.0) -> DataFrame:
    """(series_id, ts, penalty, ex_post, real_time, objective): fitted and online labels of each penalty; centroids come from the first ``fit_share`` of rows."""
    kinds = dict(feats.dtypes)
    rows = feats.withColumn("penalty", F.explode(F.array(*map(F.lit, penalties))))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ts")
        x, penalty = p[FEATURES].fillna(0.0).to_numpy(float), float(p["penalty"].iloc[0])
        c, value = centroids(x[: max(2, int(len(x) * fit_share))], penalty) if len(x) > 1 else (np.vstack([x, x]), 0.0)
        loss = 0.5 * ((x[:, None, :] - c[None]) ** 2).sum(-1)
        return pd.DataFrame({"series_id": p["series_id"], "ts": p["ts"], "penalty": penalty, "ex_post": path(loss, penalty)[0], "real_time": online(loss, penalty), "objective": value})

    return spread(rows, "series_id", "penalty").groupBy("series_id", "penalty").applyInPandas(run, f"series_id {kinds['series_id']}, ts {kinds['ts']}, penalty double, ex_post int, real_time int, objective double")


def block_features(df: DataFrame, column: str = "ret", n_fit: int = 10**9, clip: float = 5.0, size: int = 4096) -> DataFrame:
    """(series_id, ts, nine features) as ``features`` gives, with blocks of ``size`` rows as tasks."""
    rows = df.where(F.col(column).isNotNull()).select("series_id", "ts", F.col(column).cast("double").alias("x")).withColumn("loss", F.least("x", F.lit(0.0)) ** 2)
    rows = decayed(rows, {f"{name}{h}": (c, h) for h in (5, 10, 21) for name, c in (("mean", "x"), ("down", "loss"))}, size)
    for h in (5, 10, 21):
        down = F.greatest(F.sqrt(f"down{h}"), F.lit(1e-8))
        rows = rows.withColumns({f"sortino{h}": F.col(f"mean{h}") / down, f"down{h}": F.log(down)})
    rows = saved(rows.select("series_id", "ts", "rn", *FEATURES))
    own = rows.where(F.col("rn") < n_fit).groupBy("series_id").agg(*(g(c).alias(f"{n}_{c}") for c in FEATURES for n, g in (("a", F.avg), ("s", F.stddev_pop))))
    scaled = [F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(c) - F.col(f"a_{c}")) / F.when(F.col(f"s_{c}") > 1e-12, F.col(f"s_{c}")).otherwise(1.0))).alias(c) for c in FEATURES]
    return rows.join(own, "series_id").select("series_id", "ts", *scaled)


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Costs of two stretches one after the other: the cheapest state between."""
    return (first[:, :, None] + then[None]).min(1)


def block_costs(loss: np.ndarray, penalty: float) -> np.ndarray:
    """The least cost from each state before the rows to each at their end, by halves."""
    k = loss.shape[1]
    parts = penalty * (1 - np.eye(k)) + loss[:, None, :]
    while len(parts) > 1:
        odd = parts[-1:] if len(parts) % 2 else parts[:0]
        a, b = parts[: len(parts) - len(odd) : 2], parts[1 : len(parts) - len(odd) : 2]
        parts = np.concatenate([(a[:, :, :, None] + b[:, None]).min(2), odd])
    return parts[0]


def replayed(loss: np.ndarray, penalty: float, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(online labels, where each row's states come from, costs at the end) of rows that begin at those costs."""
    n, k = loss.shape
    online_, back = np.empty(n, np.int32), np.empty((n, k), np.int8)
    for t in range(n):
        best = int(np.argmin(value))
        change = value[best] + penalty
        back[t] = np.where(value <= change, np.arange(k), best)
        value = np.minimum(value, change) + loss[t]
        online_[t] = int(np.argmin(value))
    return online_, back, value


def block_labelled(feats: DataFrame, centres: DataFrame, size: int = 4096) -> DataFrame:
    """(series_id, ts, penalty, ex_post, real_time) under given ``centres``: (series_id, penalty, centres), states one after the other.

    Labels are those of ``path`` and ``online``, with blocks of ``size`` rows as tasks. Null features are 0.
    """
    series, time = (dict(feats.dtypes)[c] for c in ("series_id", "ts"))
    rows = saved(numbered(feats.select("series_id", "ts", *FEATURES), size))
    blocks = rows.groupBy("series_id", "block").agg(F.sort_array(F.collect_list(F.struct("rn", "ts", F.array(*(F.coalesce(c, F.lit(0.0)) for c in FEATURES)).alias("x")))).alias("rows"))
    blocks = saved(blocks.join(centres.select("series_id", "penalty", "centres"), "series_id"))
    key = ["series_id", "penalty"]
    kind = f"series_id {series}, penalty double, block long"
    frame = lambda out, schema: pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    def loss(r) -> np.ndarray:
        x = np.array([np.asarray(v["x"]) for v in r.rows])
        return 0.5 * ((x[:, None, :] - np.asarray(r.centres, float).reshape(-1, len(FEATURES))[None]) ** 2).sum(-1)

    def costs(frames):
        for p in frames:
            yield frame([(r.series_id, r.penalty, r.block, block_costs(loss(r), r.penalty).ravel().tolist()) for r in p.itertuples()], f"{kind}, m array")

    def forward(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("block")
        k = int(round(len(p["m"].iloc[0]) ** 0.5))
        now, out = np.zeros(k), []
        for m in p["m"]:
            out.append(now.tolist())
            now = compose(now[None], np.asarray(m).reshape(k, k))[0]
        return p[[*key, "block"]].assign(value=out)

    def ends(frames):
        for p in frames:
            out = []
            for r in p.itertuples():
                _, back, value = replayed(loss(r), r.penalty, np.asarray(r.value))
                before = np.arange(back.shape[1])
                for row in back[::-1]:
                    before = row[before]
                out.append((r.series_id, r.penalty, r.block, before.astype(int).tolist(), int(np.argmin(value))))
            yield frame(out, f"{kind}, before array, least int")

    def backward(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("block")
        now, out = int(p["least"].iloc[-1]), []
        for before in p["before"].iloc[::-1]:
            out.append(now)
            now = int(before[now])
        return p[[*key, "block"]].assign(last=out[::-1])

    labels = f"series_id {series}, ts {time}, penalty double, ex_post int, real_time int"

    def told(frames):
        for p in frames:
            out = []
            for r in p.itertuples():
                live, back, _ = replayed(loss(r), r.penalty, np.asarray(r.value))
                now, own = r.last, []
                for row in back[::-1]:
                    own.append(now)
                    now = int(row[now])
                out += [(r.series_id, v["ts"], r.penalty, a, int(b)) for v, a, b in zip(r.rows, own[::-1], live)]
            yield frame(out, labels)

    parts = blocks.mapInPandas(costs, f"{kind}, m array<double>")
    values = saved(parts.groupBy(*key).applyInPandas(forward, f"{kind}, value array<double>"))
    met = blocks.join(values, [*key, "block"]).select(*key, "block", "rows", "centres", "value")
    last = met.mapInPandas(ends, f"{kind}, before array<int>, least int").groupBy(*key).applyInPandas(backward, f"{kind}, last int")
    return met.join(last, [*key, "block"]).mapInPandas(told, labels)
