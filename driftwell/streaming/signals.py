"""Causal panel signals on streams: event-time bars, and per-series recursions with a few numbers of state.

Rows of a trigger come in any order, so a recursion keeps rows in its state until the watermark has passed them, when a timer of the
series takes them in event-time order; results do not depend on where batches end. Rows that come behind the watermark change
nothing: bars drop them, and a recursion gives them out as late if it is told to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def bars(events: DataFrame, key: str, value: str, size: str = "1 hour", slide: str | None = None, late: str = "2 hours", time: str = "ts") -> DataFrame:
    """(series_id, start, stop, n, mean, low, high) of tumbling or sliding windows."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    g = events.withWatermark(time, late).groupBy(window.alias("w"), F.col(key).alias("series_id"))
    return g.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")).select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "mean", "low", "high")


#: Rows of a chunk that goes to a series' task, of a piece of what waits, and that are sorted at once.
_CHUNK, _PIECE, _SORTED = 256, 8192, 2**18


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (series_id, us, x) of a batch as (series_id, us, x) of up to ``_CHUNK`` rows of a series each, as bytes: the runner takes what comes to a series row by row in Python."""
    for batch in batches:
        series = batch["series_id"].dictionary_encode()
        code, us, x = series.indices.to_numpy(), batch["us"].to_numpy(), batch["x"].to_numpy()
        order = np.lexsort((x, us, code))
        code, at = code[order], np.arange(len(order))
        begin = np.maximum.accumulate(np.where(np.diff(code, prepend=-1) != 0, at, 0))
        cuts = at[(at - begin) % _CHUNK == 0]
        ends = pa.py_buffer(np.append(cuts, len(at)).astype(np.int32) * 8)
        packed = [pa.Array.from_buffers(pa.binary(), len(cuts), [None, ends, pa.py_buffer(v[order].tobytes())]) for v in (us, x)]
        yield pa.RecordBatch.from_arrays([series.dictionary.take(pa.array(code[cuts])), *packed], names=["series_id", "us", "x"])


class _Recursion(StatefulProcessor):
    """Of each series: rows that the watermark has not passed, in pieces by time, and the recursion's memory."""

    def __init__(self, step, start: list[float], names: list[str]):
        self.step, self.start, self.names = step, start, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first long, number long", "us binary, x binary")
        self.pieces = handle.getValueState("pieces", "number long")
        self.memory = handle.getValueState("memory", "memory array<double>")

    def close(self) -> None:
        pass

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        self.memory.update(([float(m) for m in initialState["memory"].iloc[0]],))

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def _keep(self, us: np.ndarray, x: np.ndarray) -> None:
        order = np.lexsort((x, us))
        us, x = us[order], x[order]
        number = self.pieces.get()[0] if self.pieces.exists() else 0
        for k in range(0, len(us), _PIECE):
            self.waiting.updateValue((int(us[k]), number), (us[k : k + _PIECE].tobytes(), x[k : k + _PIECE].tobytes()))
            number += 1
        self.pieces.update((number,))

    def _taken(self, memory: list[float], x: np.ndarray) -> tuple[list[float], list]:
        """The memory after these values, and the columns of outputs."""
        if hasattr(self.step, "many"):
            return self.step.many(memory, x)
        out = []
        for v in x.tolist():
            memory, told = self.step(memory, v)
            out.append(told)
        return memory, list(zip(*out))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, first, held, n = timerValues.getCurrentWatermarkInMs() * 1000, None, [], 0
        for p in rows:
            us, x = np.frombuffer(b"".join(p["us"]), np.int64), np.frombuffer(b"".join(p["x"]), np.float64)
            late = us <= mark
            if late.any():
                yield pd.DataFrame({"series_id": key[0], "us": us[late], "late": True} | {c: None for c in self.names})
            if not late.all():
                held.append((us[~late], x[~late]))
                first = min(int(held[-1][0].min()), first) if first is not None else int(held[-1][0].min())
                n += len(held[-1][0])
            if n >= _SORTED:
                self._keep(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if held:
            self._keep(*map(np.concatenate, zip(*held)))
        if first is not None:
            self._wake(first)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        pieces = sorted(tuple(k) for k in self.waiting.keys())
        due = [k for k in pieces if k[0] <= mark]
        if not due:  # an earlier timer of this trigger has taken them
            return
        rest = [k[0] for k in pieces[len(due) : len(due) + 1]]
        memory = list(self.memory.get()[0]) if self.memory.exists() else list(self.start)
        us, x, k = np.empty(0, np.int64), np.empty(0), 0
        while k < len(due):
            held, n = [(us, x)], 0
            while k < len(due) and n < max(_SORTED, len(us)):
                value = self.waiting.getValue(due[k])
                self.waiting.removeKey(due[k])
                held.append((np.frombuffer(value[0], np.int64), np.frombuffer(value[1], np.float64)))
                n, k = n + len(held[-1][0]), k + 1
            us, x = map(np.concatenate, zip(*held))
            order = np.lexsort((x, us))
            us, x = us[order], x[order]
            done = int(np.searchsorted(us, due[k][0] if k < len(due) else mark + 1))  # no later piece has rows before
            if done:
                memory, told = self._taken(memory, x[:done])
                yield pd.DataFrame({"series_id": key[0], "us": us[:done], "late": False} | dict(zip(self.names, told)))
            us, x = us[done:], x[done:]
        self.memory.update(([float(m) for m in memory],))
        if len(us):
            self._keep(us, x)
            rest.append(int(us[0]))
        if rest:
            self._wake(min(rest))


def recursion(
    events: DataFrame, key: str, value: str, step, start: list[float], columns: str, late: str = "2 hours", time: str = "ts", told_late: bool = False, history: DataFrame | None = None
) -> DataFrame:
    """(series_id, ts, columns): ``step(memory, value) -> (memory, outputs)`` over each series' rows in event-time order.

    A step may have ``many(memory, values) -> (memory, columns of outputs)`` for an array of values, with the same results.
    events: a stream, whose query needs the RocksDB state store (``run.ROCKS``); rows of equal time are taken by value. Rows without a
    series, time or value are left out.
    told_late: rows that come behind the watermark come out too, with nulls, and a column ``late`` tells them from the others.
    history: (series_id, memory), one row a series, of series that do not begin at ``start``, as ``remembered`` gives.
    """
    marked = events.withWatermark(time, late).select(F.col(key).cast("string").alias("series_id"), F.unix_micros(F.col(time)).alias("us"), F.col(value).cast("double").alias("x"))
    rows = marked.where("series_id is not null and us is not null and x is not null")
    rows = rows.mapInArrow(_chunks, "series_id string, us binary, x binary")
    names = [c.split()[0] for c in columns.split(", ")]
    begun = None if history is None else history.select(F.col("series_id").cast("string").alias("series_id"), "memory").groupBy("series_id")
    done = rows.groupBy("series_id").transformWithStateInPandas(_Recursion(step, start, names), f"series_id string, us long, late boolean, {columns}", "Append", "EventTime", begun)
    out = done if told_late else done.where(~F.col("late"))
    return out.select("series_id", F.timestamp_micros("us").alias("ts"), *(["late"] if told_late else []), *names)


def remembered(panel: DataFrame, key: str, value: str, step, start: list[float], time: str = "ts") -> DataFrame:
    """(series_id, memory) after all rows of a table, a task a series, for a stream that goes on from there."""
    rows = panel.select(F.col(key).cast("string").alias("series_id"), F.unix_micros(F.col(time)).alias("us"), F.col(value).cast("double").alias("x")).where("series_id is not null and us is not null and x is not null")

    def run(id: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = list(start)
        for p in frames:
            for x in p["x"]:
                memory, _ = step(memory, float(x))
        yield pd.DataFrame({"series_id": [id[0]], "memory": [[float(m) for m in memory]]})

    sorted_rows = rows.repartition("series_id").sortWithinPartitions("series_id", "us", "x")
    return sorted_rows.groupBy("series_id").applyInPandas(run, "series_id string, memory array<double>")


def ewma_step(alpha: float = 0.06):
    """Log return and exponentially weighted variance; memory: last price, variance, rows so far."""

    def step(memory: list[float], x: float) -> tuple[list[float], tuple]:
        last, variance, n = memory
        ret = float(np.log(x / last)) if n and x > 0 and last > 0 else None
        if ret is not None:
            variance = ret * ret if n == 1 else (1 - alpha) * variance + alpha * ret * ret
        return [x if x > 0 else last, variance, n + 1], (ret, float(np.sqrt(variance)))

    def many(memory: list[float], x: np.ndarray) -> tuple[list[float], list]:
        last, variance, n = memory
        prices = np.append(last, x)
        known = np.maximum.accumulate(np.where(prices > 0, np.arange(len(prices)), 0))
        before = prices[known[:-1]]
        has = (x > 0) & (before > 0) & (n + np.arange(len(x)) > 0)
        ret = np.full(len(x), np.nan)
        ret[has] = np.log(x[has] / before[has])
        news = (alpha * ret * ret)[has].tolist()
        variances = [variance]
        if n <= 1 < n + len(x) and has[int(1 - n)]:  # the second row is the first that may have a return
            variances.append(float(ret[int(1 - n)] * ret[int(1 - n)]))
        for new in news[len(variances) - 1 :]:
            variance = (1 - alpha) * variances[-1] + new
            variances.append(variance)
        vol = np.sqrt(np.array(variances))[np.cumsum(has)]
        return [float(prices[known[-1]]), variances[-1], n + len(x)], [ret, vol]

    step.many = many
    return step


def hmm_step(pi: list[float], a: list[list[float]], mu: list[float], sd: list[float]):
    """The filtered probability of the last state; memory: predicted state probabilities."""
    trans, m, s = np.array(a), np.array(mu), np.array(sd)

    def step(memory: list[float], x: float) -> tuple[list[float], tuple]:
        logb = -0.5 * ((x - m) / s) ** 2 - np.log(s)
        now = np.array(memory) * np.exp(logb - logb.max())
        now = now / now.sum()
        return (now @ trans).tolist(), (float(now[-1]), int(now.argmax() == len(now) - 1))

    return step, list(pi)


def jump_step(centroids: list[float], penalty: float):
    """The online label for a one-dimensional feature; memory: the value of each state."""
    c = np.array(centroids)

    def step(memory: list[float], x: float) -> tuple[list[float], tuple]:
        value = np.array(memory)
        value = np.minimum(value, value.min() + penalty) + 0.5 * (x - c) ** 2
        value = value - value.min()
        return value.tolist(), (int(np.argmin(value)),)

    def many(memory: list[float], x: np.ndarray) -> tuple[list[float], list]:
        costs, value, labels = 0.5 * (x[:, None] - c) ** 2, memory, []
        if not (np.isfinite(costs).all() and np.isfinite(memory).all()):
            for v in x.tolist():
                value, told = step(value, v)
                labels += told
            return value, [labels]
        for cost in costs.tolist():
            most = min(value) + penalty
            value = [(v if v < most else most) + e for v, e in zip(value, cost)]
            least = min(value)
            value = [v - least for v in value]
            labels.append(value.index(0.0))
        return value, [labels]

    step.many = many
    return step, [0.0] * len(c)
