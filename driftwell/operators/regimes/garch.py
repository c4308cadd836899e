"""GARCH(1,1) with normal or Student errors, by maximum likelihood; and its variances and residuals.

The recursion of variance and of its derivatives is affine in what it carries: over a block of rows it is a start-free part and a
power of beta. A round of the search is thus a pass over blocks for those parts, carries over a series' blocks (one row a block), and a second pass that
sums likelihood, gradient and outer products. Several candidate parameters are an axis of both passes, so a round also is a line search. A series of one
block does all its rounds in a task of its own; a longer one takes as many jobs as rounds, for all such series at once, and leaves when it has settled.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.functions.distributions import normal_ppf, student_cdf
from driftwell.operators.blocks import numbered, recursion, saved, spread


def variances(e2: np.ndarray, target: float, alpha: np.ndarray, beta: np.ndarray, omega: np.ndarray | None = None) -> np.ndarray:
    """Conditional variances, time by parameter; omega is (1 - alpha - beta) * target where none is given."""
    out = np.empty((len(e2), len(alpha)))
    now = np.full(len(alpha), target)
    omega = (1 - alpha - beta) * target if omega is None else omega
    for t, x in enumerate(e2):
        out[t] = now
        now = omega + alpha * x + beta * now
    return out


def loglik(e2: np.ndarray, h: np.ndarray, nu: float | None) -> np.ndarray:
    if nu is None:
        return -0.5 * (math.log(2 * math.pi) * len(e2) + np.log(h).sum(0) + (e2[:, None] / h).sum(0))
    c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
    return c * len(e2) - 0.5 * np.log(h).sum(0) - (nu + 1) / 2 * np.log1p(e2[:, None] / (h * (nu - 2))).sum(0)


#: Steps along a direction that a round tries.
STEPS = (1.0, 0.5, 0.25, 0.1, 0.03, 2.0, 4.0)
#: mean, omega, alpha, beta, nu
P = 5
#: Bounds of free parameters; nu ends at 500, where the laws are the same.
_LEAST, _MOST = np.array([-12.0, -12.0, -12.0, -20.0, -12.0]), np.array([12.0, 12.0, 12.0, 20.0, math.log(498.0)])


def natural(phi: np.ndarray, mean: float, target: float) -> np.ndarray:
    """(mean, omega, alpha, beta, nu) of free parameters: mean in deviations, log omega in variances, logits of alpha + beta and of alpha's part of it, log of nu over 2."""
    p, s = 1 / (1 + np.exp(-phi[..., 2])), 1 / (1 + np.exp(-phi[..., 3]))
    return np.stack([mean + math.sqrt(target) * phi[..., 0], target * np.exp(phi[..., 1]), p * s, p * (1 - s), 2.01 + np.exp(phi[..., 4])], -1)


def jacobian(phi: np.ndarray, target: float) -> np.ndarray:
    """Derivatives of ``natural``, parameter by free parameter."""
    p, s = 1 / (1 + np.exp(-phi[..., 2])), 1 / (1 + np.exp(-phi[..., 3]))
    out = np.zeros((*phi.shape, P))
    out[..., 0, 0], out[..., 1, 1], out[..., 4, 4] = math.sqrt(target), target * np.exp(phi[..., 1]), np.exp(phi[..., 4])
    out[..., 2, 2], out[..., 3, 2] = s * p * (1 - p), (1 - s) * p * (1 - p)
    out[..., 2, 3], out[..., 3, 3] = p * s * (1 - s), -p * s * (1 - s)
    return out


def _states(x: np.ndarray, theta: np.ndarray, target: float, first: bool, carry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Errors and (variance, its derivatives by mean, omega, alpha, beta), candidates by these by rows of a block.

    ``x`` begins with the last value of the block before, but for the first block, whose first row has variance ``target``. ``carry`` is what the block before ends with.
    """
    mean, omega, alpha, beta = (theta[:, k, None] for k in range(4))
    e = x - mean
    before = e[:, :-1]
    if not len(x) - 1:  # a first block of one row
        return e, np.concatenate([np.full((len(theta), 1, 1), target), np.zeros((len(theta), 4, 1))], 1)
    b = beta[:, 0]
    start = np.full(len(theta), target) if first else carry[:, 0]
    slope = np.zeros((len(theta), 4)) if first else carry[:, 1:]
    h = recursion(omega + alpha * before**2, b, start)
    last = np.concatenate([start[:, None], h[:, :-1]], 1)
    parts = [h, *(recursion(u, b, slope[:, k]) for k, u in enumerate((-2 * alpha * before, np.ones_like(before), before**2, last)))]
    out = np.stack(parts, 1)
    if first:
        begin = np.concatenate([np.full((len(theta), 1, 1), target), np.zeros((len(theta), 4, 1))], 1)
        return e, np.concatenate([begin, out], 2)
    return e[:, 1:], out


def block_part(x: np.ndarray, theta: np.ndarray, target: float, first: bool) -> np.ndarray:
    """What a block ends with if nothing is carried into it."""
    return _states(x, theta, target, first, np.zeros((len(theta), P)))[1][:, :, -1]


def carried_over(part: np.ndarray, carry: np.ndarray, beta: np.ndarray, rows: int) -> np.ndarray:
    """What a block of ``rows`` rows ends with, if ``carry`` comes into it."""
    out = part + beta[:, None] ** rows * carry
    out[:, 4] += rows * beta ** (rows - 1) * carry[:, 0]
    return out


def _constant(nu: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(math.pi * (v - 2)) for v in nu.tolist()])


def block_sums(x: np.ndarray, theta: np.ndarray, target: float, first: bool, carry: np.ndarray, student: bool) -> np.ndarray:
    """Log likelihood, gradient and its outer products summed over a block, one row a candidate."""
    e, state = _states(x, theta, target, first, carry)
    h, nu = np.maximum(state[:, 0], 1e-300), theta[:, 4]
    g = np.zeros((len(theta), P, e.shape[1]))
    if student:
        free = (nu - 2)[:, None]
        q = e * e / (h * free)
        log = np.log1p(q)
        half = (nu[:, None] + 1) / 2
        ll = _constant(nu)[:, None] - 0.5 * np.log(h) - half * log
        by_h = (-0.5 + half * q / (1 + q)) / h
        own = 2 * half * e / (h * free * (1 + q))
        d = 1e-5 * nu
        g[:, 4] = ((_constant(nu + d) - _constant(nu - d)) / (2 * d))[:, None] - 0.5 * log + half * q / ((1 + q) * free)
    else:
        ll = -0.5 * (math.log(2 * math.pi) + np.log(h) + e * e / h)
        by_h = -0.5 / h + 0.5 * e * e / (h * h)
        own = e / h
    g[:, :4] = by_h[:, None] * state[:, 1:]
    g[:, 0] += own
    return np.concatenate([ll.sum(1)[:, None], g.sum(2), np.einsum("jpt,jqt->jpq", g, g).reshape(len(theta), -1)], 1)


class Search:
    """A quasi-Newton search: the inverse curvature is that of the gradients' outer products at first and follows the changes of the gradient then.

    ``asked`` are the candidates of a round and ``tell`` takes their sums. It settles when no step helps, or one helps by less than ``tolerance``.
    """

    def __init__(self, mean: float, target: float, student: bool, start: np.ndarray, tolerance: float = 1e-7):
        self.mean, self.target, self.student, self.tolerance = mean, target, student, tolerance
        self.phi, self.value, self.slope, self.inverse, self.settled, self.fresh = np.array(start, float), -np.inf, np.zeros(P), np.eye(P), False, True

    def state(self) -> list[float]:
        return [*self.phi, self.value, *self.slope, *self.inverse.ravel(), float(self.settled), float(self.fresh)]

    def restored(self, state: list[float]) -> Search:
        self.phi, self.value, self.slope, self.inverse = np.array(state[:P]), state[P], np.array(state[P + 1 : 2 * P + 1]), np.array(state[2 * P + 1 : -2]).reshape(P, P)
        self.settled, self.fresh = bool(state[-2]), bool(state[-1])
        return self

    def points(self) -> np.ndarray:
        if not np.isfinite(self.value):
            return self.phi[None]
        # what stands at a bound and would go beyond stays there
        free = ~((self.phi <= _LEAST) & (self.slope < 0) | (self.phi >= _MOST) & (self.slope > 0))
        slope = np.where(free, self.slope, 0.0)
        way = np.where(free, self.inverse @ slope, 0.0)
        if way @ slope <= 0:
            way = slope
        way = way * min(1.0, 3 / max(np.abs(way).max(), 1e-300))
        points = np.clip(self.phi + np.array(STEPS)[:, None] * way, _LEAST, _MOST)
        if not self.student:
            points[:, 4] = self.phi[4]
        return points

    def asked(self) -> np.ndarray:
        return natural(self.points(), self.mean, self.target)

    def tell(self, sums: np.ndarray) -> None:
        points, value = self.points(), np.where(np.isfinite(sums[:, 0]), sums[:, 0], -np.inf)
        i = int(np.argmax(value))
        slopes = jacobian(points[i], self.target)
        slope = sums[i, 1 : P + 1] @ slopes
        outer = slopes.T @ sums[i, P + 1 :].reshape(P, P) @ slopes
        outer = np.linalg.inv(outer + np.diag(1e-6 * np.diag(outer) + 1e-8))
        if not np.isfinite(self.value):
            self.value, self.slope, self.inverse = float(value[i]), slope, outer
            return
        gain = value[i] - self.value
        if gain <= self.tolerance:
            if gain > 0:
                self.phi, self.value, self.slope = points[i], float(value[i]), slope
            # once more with the curvature of here, unless that is what was tried
            self.settled, self.fresh, self.inverse = self.fresh, True, outer
            return
        s, y = points[i] - self.phi, self.slope - slope  # of minus the likelihood
        if s @ y > 1e-12:
            rho = 1 / (s @ y)
            left = np.eye(P) - rho * np.outer(s, y)
            self.inverse = left @ self.inverse @ left.T + rho * np.outer(s, s)
        else:
            self.inverse = outer
        self.phi, self.value, self.slope, self.fresh = points[i], float(value[i]), slope, False


def starts(student: bool) -> np.ndarray:
    """Free parameters of a coarse grid."""
    logit = lambda p: math.log(p / (1 - p))
    return np.array([(0.0, math.log(1 - p), logit(p), logit(a / p), math.log(nu - 2.01)) for p in (0.5, 0.8, 0.95, 0.985) for a in (0.03, 0.1, 0.25) for nu in ((4.5, 8.0, 20.0) if student else (8.0,))])


def _chosen(points: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """The best points of a grid, of different alpha + beta."""
    order = [i for i in np.argsort(-values, kind="stable") if np.isfinite(values[i])]
    kept: list[int] = []
    for i in order:
        if all(points[i, 2] != points[j, 2] for j in kept) and len(kept) < count:
            kept.append(i)
    return points[kept]


def _summed(blocks: list[np.ndarray], theta: np.ndarray, target: float, student: bool) -> np.ndarray:
    """Sums over all blocks of a series in one task."""
    total, carry = 0.0, np.zeros((len(theta), P))
    for k, x in enumerate(blocks):
        total = total + block_sums(x, theta, target, k == 0, carry, student)
        carry = carried_over(block_part(x, theta, target, k == 0), carry, theta[:, 3], len(x) - (k > 0))
    return total


PARAMETERS = "law string, alpha double, beta double, omega double, nu double, mean double, target double, loglik double, bic double, n long, converged boolean"


def _row(search: Search, n: int) -> tuple:
    mean, omega, alpha, beta, nu = natural(search.phi, search.mean, search.target).tolist()
    law = "student" if search.student else "normal"
    return law, alpha, beta, omega, nu if search.student else 0.0, mean, search.target, search.value, -2 * search.value + (5 if search.student else 4) * math.log(n), n, search.settled


def by_law(df: DataFrame, column: str = "ret", laws: tuple[str, ...] = ("normal", "student"), count: int = 3, most: int = 150, size: int = 4096, least: int = 50) -> DataFrame:
    """(series_id, law, alpha, beta, omega, nu, mean, target, loglik, bic, n, converged): the most likely parameters under each law of errors.

    The first variance is ``target``, the series' own; mean, omega, alpha, beta and nu (0 under the normal law) are free, with alpha + beta under 1. Each search
    goes on from the best ``count`` points of a grid with different alpha + beta until it settles, ``most`` rounds at most. Series of under ``least`` values, or of one value, are left out.
    """
    spark, series = df.sparkSession, dict(df.dtypes)["series_id"]
    rows = saved(numbered(df.where(F.col(column).isNotNull()).select("series_id", "ts", F.col(column).cast("double").alias("x")), size))
    stats = rows.groupBy("series_id").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("v") > 0))
    # the last row of a block also opens the next one
    both = F.when(((F.col("rn") + 1) % size == 0), F.array(F.col("block"), F.col("block") + 1)).otherwise(F.array("block"))
    dealt = rows.select("series_id", "rn", "x", F.explode(both).alias("block"))
    blocks = dealt.groupBy("series_id", "block").agg(F.sort_array(F.collect_list(F.struct("rn", "x"))).alias("xs")).select("series_id", "block", F.col("xs.x").alias("xs"))
    blocks = saved(blocks.join(stats, "series_id").where(F.col("block") * size < F.col("n")))

    schema = f"series_id {series}, {PARAMETERS}"
    names = [c.split()[0] for c in schema.split(", ")]

    def whole(p: pd.DataFrame) -> pd.DataFrame:
        f, out = p.iloc[0], []
        x = [np.asarray(f["xs"], float)]
        for law in laws:
            student = law == "student"
            grid = starts(student)
            value = _summed(x, natural(grid, f["m"], f["v"]), f["v"], student)[:, 0]
            found = []
            for phi in _chosen(grid, value, count):
                search = Search(f["m"], f["v"], student, phi)
                for _ in range(most):
                    search.tell(_summed(x, search.asked(), f["v"], student))
                    if search.settled:
                        break
                found.append(search)
            if found:
                out.append((f["series_id"], *_row(max(found, key=lambda s: s.value), int(f["n"]))))
        return pd.DataFrame(out, columns=names)

    short = spread(blocks.where(F.col("n") <= size), "series_id").groupBy("series_id").applyInPandas(whole, schema)
    long = blocks.where(F.col("n") > size)
    found = _by_rounds(long, series, schema, laws, count, most) if not long.isEmpty() else None
    return short if found is None else short.unionByName(found)


def _by_rounds(blocks: DataFrame, series: str, schema: str, laws: tuple[str, ...], count: int, most: int) -> DataFrame:
    """The same of series of several blocks: a round is a job, and settled searches take no part in it."""
    key = ["series_id", "law", "start"]
    kind = f"series_id {series}, law string, start int"
    columns = lambda schema: [c.split()[0] for c in schema.split(", ")]

    def sums(asked: DataFrame) -> DataFrame:
        """(key, sums) of the asked (key, theta), candidate after candidate."""
        met = blocks.join(asked, "series_id")

        def part(frames):
            for p in frames:
                out = [(r.series_id, r.law, r.start, r.block, len(r.xs) - (r.block > 0), block_part(np.asarray(r.xs), np.asarray(r.theta).reshape(-1, P), r.v, r.block == 0).ravel().tolist(), r.theta) for r in p.itertuples()]
                yield pd.DataFrame(out, columns=[*key, "block", "rows", "part", "theta"])

        def carries(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("block")
            theta = np.asarray(p["theta"].iloc[0]).reshape(-1, P)
            carry, out = np.zeros_like(theta), []
            for rows, own in zip(p["rows"], p["part"]):
                out.append(carry.ravel().tolist())
                carry = carried_over(np.asarray(own).reshape(-1, P), carry, theta[:, 3], rows)
            return p[[*key, "block", "theta"]].assign(carry=out)

        def told(frames):
            for p in frames:
                out = [(r.series_id, r.law, r.start, block_sums(np.asarray(r.xs), np.asarray(r.theta).reshape(-1, P), r.v, r.block == 0, np.asarray(r.carry).reshape(-1, P), r.law == "student").ravel().tolist()) for r in p.itertuples()]
                yield pd.DataFrame(out, columns=[*key, "own"])

        parts = met.select("series_id", "law", "start", "block", "xs", "v", "theta").mapInPandas(part, f"{kind}, block long, rows int, part array<double>, theta array<double>")
        carried = parts.groupBy(*key).applyInPandas(carries, f"{kind}, block long, theta array<double>, carry array<double>")
        own = blocks.join(carried, ["series_id", "block"]).select(*key, "block", "xs", "v", "theta", "carry").mapInPandas(told, f"{kind}, own array<double>")
        added = own.select(*key, F.posexplode("own").alias("place", "x")).groupBy(*key, "place").agg(F.sum("x").alias("x"))
        return added.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("sums")).select(*key, F.col("sums.x").alias("sums"))

    heads = blocks.where("block = 0").select("series_id", "m", "v", "n")
    width = 1 + P + P * P
    grids = {law: starts(law == "student") for law in laws}
    state_kind = f"{kind}, m double, v double, n long, state array<double>"

    def first(frames):
        for p in frames:
            yield pd.DataFrame([(r.series_id, law, 0, natural(grids[law], r.m, r.v).ravel().tolist()) for r in p.itertuples() for law in laws], columns=[*key, "theta"])

    def begun(frames):
        for p in frames:
            out = []
            for r in p.itertuples():
                value = np.asarray(r.sums).reshape(-1, width)[:, 0]
                out += [(r.series_id, r.law, k, r.m, r.v, r.n, Search(r.m, r.v, r.law == "student", phi).state()) for k, phi in enumerate(_chosen(grids[r.law], value, count))]
            yield pd.DataFrame(out, columns=columns(state_kind))

    def search(r) -> Search:
        return Search(r.m, r.v, r.law == "student", np.zeros(P)).restored(list(r.state))

    def asked(frames):
        for p in frames:
            yield pd.DataFrame([(r.series_id, r.law, r.start, search(r).asked().ravel().tolist()) for r in p.itertuples()], columns=[*key, "theta"])

    def advanced(frames):
        for p in frames:
            out = []
            for r in p.itertuples():
                s = search(r)
                s.tell(np.asarray(r.sums).reshape(-1, width))
                out.append((r.series_id, r.law, r.start, r.m, r.v, r.n, s.state()))
            yield pd.DataFrame(out, columns=columns(state_kind))

    open_ = saved(sums(heads.mapInPandas(first, f"{kind}, theta array<double>")).join(heads, "series_id").mapInPandas(begun, state_kind))
    settled = F.element_at("state", -2) > 0
    done = []
    for _ in range(most):
        told = sums(open_.mapInPandas(asked, f"{kind}, theta array<double>"))
        now = saved(open_.join(told, key).mapInPandas(advanced, state_kind))
        done.append(now.where(settled))
        open_ = now.where(~settled)
        if open_.isEmpty():
            break

    def rows(frames):
        for p in frames:
            yield pd.DataFrame([(r.series_id, *_row(search(r), int(r.n))) for r in p.itertuples()], columns=columns(schema))

    all_ = reduce(DataFrame.unionByName, [*done, open_]).mapInPandas(rows, schema)
    names = [c for c in columns(schema) if c not in ("series_id", "law", "loglik")]
    best = all_.groupBy("series_id", "law").agg(F.max(F.struct("loglik", *names)).alias("b"))
    return best.select("series_id", "law", "b.*").select(*columns(schema))


def fitted(df: DataFrame, column: str = "ret", laws: tuple[str, ...] = ("normal", "student"), size: int = 4096, least: int = 50) -> DataFrame:
    """(series_id, law, alpha, beta, omega, nu, mean, target, loglik, bic, n, converged): of ``by_law``, the law of least BIC."""
    found = by_law(df, column, laws, size=size, least=least)
    names = [c for c in found.columns if c not in ("series_id", "bic")]
    best = found.groupBy("series_id").agg(F.min(F.struct("bic", *names)).alias("b")).select("series_id", "b.*")
    return best.select(*found.columns)


def gridded(df: DataFrame, column: str = "ret", nus: tuple[float, ...] = (0.0, 4.0, 6.0, 8.0, 12.0), rounds: int = 2, steps: int = 9, least: int = 50) -> DataFrame:
    """(series_id, alpha, beta, nu, mean, target, loglik, bic, n): nu 0 is the normal; mean and unconditional variance are those of the series.

    A coarser search than ``fitted``, by grids that get finer: omega follows from alpha, beta and the variance, and the mean is the series' own. A group is a series, an alpha and an error law; it takes all betas at once.
    """
    kinds = dict(df.dtypes)
    rows = df.where(F.col(column).isNotNull()).select("series_id", "ts", F.col(column).cast("double").alias("x"))
    stats = rows.groupBy("series_id").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("target"), F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("target") > 0))
    rows = rows.join(stats, "series_id")
    width = 1.0
    schema = f"series_id {kinds['series_id']}, alpha double, beta double, nu double, mean double, target double, loglik double, n long"

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ts")
        f = p.iloc[0]
        e2 = (p["x"].to_numpy(float) - f["mean"]) ** 2
        beta = np.array(f["betas"], float)
        beta = beta[(beta >= 0) & (f["alpha"] + beta < 0.999)]
        if not len(beta):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        ll = loglik(e2, variances(e2, f["target"], np.full(len(beta), f["alpha"]), beta), f["nu"] or None)
        i = int(np.argmax(ll))
        return pd.DataFrame([{"series_id": f["series_id"], "alpha": f["alpha"], "beta": beta[i], "nu": f["nu"], "mean": f["mean"], "target": f["target"], "loglik": ll[i], "n": int(f["n"])}])

    best = None
    for _ in range(rounds + 1):
        law = F.explode(F.array(*map(F.lit, nus)))
        if best is None:
            grid = rows.withColumn("alpha", F.explode(F.array(*(F.lit(0.02 + 0.28 * i / (steps - 1)) for i in range(steps))))).withColumn("nu", law)
            grid = grid.withColumn("betas", F.array(*(F.lit(0.5 + 0.48 * i / (2 * steps)) for i in range(2 * steps + 1))))
        else:
            near = best.select("series_id", F.col("alpha").alias("a0"), F.col("beta").alias("b0"), "nu")
            grid = rows.join(near, "series_id").withColumn("alpha", F.explode(F.array(*(F.greatest(F.lit(0.0), F.col("a0") + (i / (steps - 1) - 0.5) * 0.07 * width) for i in range(steps)))))
            grid = grid.withColumn("betas", F.array(*(F.col("b0") + (i / (2 * steps) - 0.5) * 0.06 * width for i in range(2 * steps + 1)))).drop("a0", "b0")
        tried = spread(grid, "series_id", "alpha", "nu").groupBy("series_id", "alpha", "nu").applyInPandas(run, schema)
        best = tried.groupBy("series_id").agg(F.max(F.struct("loglik", "alpha", "beta", "nu", "mean", "target", "n")).alias("b")).select("series_id", "b.*")
        width /= 4
    p = F.when(F.col("nu") > 0, 5).otherwise(4)
    return best.withColumn("bic", -2 * F.col("loglik") + p * F.log("n"))


def residuals(df: DataFrame, parameters: DataFrame, column: str = "ret") -> DataFrame:
    """(series_id, ts, variance, z, pit): standardised residuals, and them through their distribution function and the normal's inverse."""
    kinds = dict(df.dtypes)
    rows = df.where(F.col(column).isNotNull()).select("series_id", "ts", F.col(column).cast("double").alias("x"))

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame(columns=["series_id", "ts", "variance", "z", "pit"])
        p, f = p.sort_values("ts"), q.iloc[0]
        e = p["x"].to_numpy(float) - f["mean"]
        h = variances(e * e, f["target"], np.array([f["alpha"]]), np.array([f["beta"]]), np.array([f["omega"]]))[:, 0]
        z, nu = e / np.sqrt(h), float(f["nu"])
        pit = [normal_ppf(student_cdf(v * math.sqrt(nu / (nu - 2)), nu)) for v in z] if nu > 0 else z
        return pd.DataFrame({"series_id": p["series_id"], "ts": p["ts"], "variance": h, "z": z, "pit": pit})

    return rows.groupBy("series_id").cogroup(parameters.withColumnRenamed("series_id", "_series").groupBy("_series")).applyInPandas(run, f"series_id {kinds['series_id']}, ts {kinds['ts']}, variance double, z double, pit double")
