"""Streams against the same recursion over the whole table, whatever the batches; late rows."""

import datetime as dt
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from driftwell.streaming import run, signals
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
HMM = signals.hmm_step([0.5, 0.5], [[0.95, 0.05], [0.05, 0.95]], [40.0, 60.0], [20.0, 40.0])
JUMP = signals.jump_step([40.0, 60.0], 3.0)
STEPS = {
    "volatility": (signals.ewma_step(), [0.0, 0.0, 0.0], "ret double, vol double"),
    "hmm": (*HMM, "p_high double, label int"),
    "jump": (*JUMP, "label int"),
}


def rows(n=120, seed=3):
    """(series, minute, value) that come up to 90 minutes out of order, with nulls and ties of time."""
    rng = random.Random(seed)
    made = [(rng.choice("abc"), 10 * (k // 2), rng.uniform(10, 90)) for k in range(n)]
    made.sort(key=lambda r: r[1] + rng.uniform(0, 90))
    return [*made[:30], (None, 5, 1.0), ("a", 100, None), *made[30:]]


def streamed(spark, folder, batches):
    """A stream of files, one a trigger, in that order."""
    kind = "series string, minute long, value double"
    for k, batch in enumerate(batches):
        at = f"{folder}/{k:03d}"
        spark.createDataFrame(batch, kind).coalesce(1).write.parquet(at)
        (file,) = spark.read.parquet(at).inputFiles()
        os.utime(file.removeprefix("file://"), (1_700_000_000 + 10 * k,) * 2)
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    return source.withColumn("ts", F.timestamp_seconds(F.lit(int(T0.timestamp())) + F.col("minute") * 60))


def direct(batch, step, start, until):
    """(series, minute, outputs) of all rows up to that minute, in order."""
    out, memory = [], {}
    for s, m, x in sorted((r for r in batch if None not in r), key=lambda r: (r[0], r[1], r[2])):
        if m <= until:
            memory[s], told = step(memory.get(s, start), x)
            out.append((s, m, *told))
    return sorted(out, key=str)


def minutes(got):
    return sorted(((r.series_id, int((r.ts.astimezone(dt.timezone.utc) - T0).total_seconds() // 60), *r[2:]) for r in got), key=str)


@pytest.mark.parametrize("name, size", [("volatility", 1000), ("volatility", 25), ("hmm", 40), ("jump", 40)])
def test_rows_in_time_equal_the_batch_recursion_whatever_the_batches(spark, tmp_path, name, size):
    step, start, columns = STEPS[name]
    every = rows()
    batches = [every[k : k + size] for k in range(0, len(every), size)]
    stream = streamed(spark, tmp_path, batches)
    got = minutes(run.available(signals.recursion(stream, "series", "value", step, start, columns)).collect())
    want = direct(every, step, start, max(r[1] for r in every) - 120)
    assert [g[:2] for g in got] == [w[:2] for w in want] and len(want) > 60
    for g, w in zip(got, want):
        assert list(g[2:]) == pytest.approx(list(w[2:]), nan_ok=True) or g[2:] == w[2:]


def test_late_rows_come_out_as_late_and_change_nothing(spark, tmp_path):
    step, start, columns = STEPS["hmm"]
    first = [("a", 10 * k, float(30 + k)) for k in range(40)]
    late = [("a", 20, 99.0), ("a", 270, 1.0), ("b", 30, 5.0)]  # the watermark is at 270 when these come
    then = [("a", 275, 50.0), ("b", 400, 7.0), ("a", 700, 50.0)]
    got = run.available(signals.recursion(streamed(spark, tmp_path, [first, late + then]), "series", "value", step, start, columns, told_late=True))
    assert sorted((r.series_id, int((r.ts.astimezone(dt.timezone.utc) - T0).total_seconds() // 60)) for r in got.where("late").collect()) == sorted(r[:2] for r in late)
    told = minutes(got.where("not late").drop("late").collect())
    want = direct(first + then, step, start, 580)
    assert [g[:2] for g in told] == [w[:2] for w in want]
    assert [g[2] for g in told] == pytest.approx([w[2] for w in want])


def test_a_stream_goes_on_from_a_table(spark, tmp_path):
    step, start, columns = STEPS["volatility"]
    before, after = [("a", 10 * k, 50.0 + k % 7) for k in range(30)], [("a", 300 + 10 * k, 50.0 + k % 5) for k in range(30)] + [("new", 310, 3.0)]
    panel = spark.createDataFrame(before, "series string, minute long, value double").withColumn("ts", F.timestamp_seconds(F.lit(int(T0.timestamp())) + F.col("minute") * 60))
    history = signals.remembered(panel, "series", "value", step, start)
    got = minutes(run.available(signals.recursion(streamed(spark, tmp_path, [after]), "series", "value", step, start, columns, history=history)).collect())
    want = [w for w in direct(before + after, step, start, 590 - 120) if w[1] >= 300]
    assert [g[:2] for g in got] == [w[:2] for w in want] and len(got) == 19
    for g, w in zip(got, want):
        assert g[2:] == pytest.approx(w[2:]) or g[2:] == w[2:]


ODD = [0.0, 5.0, -1.0, 5.0, float("nan"), 7.0, 0.0, 0.0, 2.0, 2.0, float("inf"), 3.0, 3.5, 1e-300, 4.0, *(float(10 + 7 * k % 31) for k in range(300))]


@pytest.mark.parametrize("name, values", [("volatility", ODD), ("volatility", ODD[1:]), ("volatility", ODD[15:]), ("jump", ODD), ("jump", ODD[15:])])
def test_many_values_at_once_equal_steps(name, values):
    step, start, _ = STEPS[name]
    with np.errstate(all="ignore"):
        for cuts in ([len(values)], [1, 2, 3, 9, len(values)], list(range(1, len(values) + 1))):
            one = many = start
            for a, b in zip([0, *cuts], cuts):
                many, columns = step.many(many, np.array(values[a:b]))
                for k, v in enumerate(values[a:b]):
                    one, told = step(one, v)
                    assert np.array_equal([np.nan if t is None else t for t in told], [c[k] for c in columns], equal_nan=True), (a, k)
            assert np.array_equal(one, many, equal_nan=True)


@pytest.mark.parametrize("name", ["volatility", "jump"])
def test_a_long_series_in_one_batch(spark, tmp_path, name):
    """More rows than are sorted at once, out of order and with ties."""
    step, start, columns = STEPS[name]
    n = 400_000
    at = F.pmod(F.xxhash64("id"), F.lit(n // 2))
    made = spark.range(n).select(F.lit("a").alias("series"), at.alias("minute"), (20 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(60))).cast("double").alias("value"))
    made.coalesce(1).write.parquet(f"{tmp_path}/rows")
    rows = made.toPandas().sort_values(["minute", "value"])
    rows = rows[rows.minute <= rows.minute.max() - 120]
    memory, want = start, []
    for x in rows.value.tolist():
        memory, told = step(memory, x)
        want.append(told)
    source = spark.readStream.schema("series string, minute long, value double").parquet(f"{tmp_path}/rows")
    stream = source.withColumn("ts", F.timestamp_seconds(F.lit(int(T0.timestamp())) + F.col("minute") * 60))
    out = run.available(signals.recursion(stream, "series", "value", step, start, columns))
    got = out.withColumn("_row", F.monotonically_increasing_id()).orderBy("_row").toPandas()
    assert (((got.ts - T0.replace(tzinfo=None)).dt.total_seconds() // 60).to_numpy() == rows.minute.to_numpy()).all()
    assert np.array_equal(got[[c.split()[0] for c in columns.split(", ")]].to_numpy(float), np.array(want, float), equal_nan=True)


def test_rows_come_to_a_series_in_chunks():
    """Before, each row went through the runner, the state and the step alone."""
    rng = random.Random(8)
    data = sorted(((rng.choice("abc"), rng.randrange(4000), float(rng.randrange(9))) for _ in range(10_000)), key=lambda r: rng.random())
    data += [("once", 7, 1.0)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*data)], names=["series_id", "us", "x"])
    (chunks,) = signals._chunks(iter([batch]))
    back = [(s, *r) for s, us, x in zip(*(c.to_pylist() for c in chunks.columns)) for r in zip(np.frombuffer(us, np.int64).tolist(), np.frombuffer(x).tolist())]
    assert sorted(back) == sorted(data) and chunks.num_rows <= len(data) / signals._CHUNK + 4
    assert sum(c.num_rows for c in signals._chunks(iter([batch.slice(0, 0)]))) == 0
