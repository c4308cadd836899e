"""Order statistics over ranges against windows over whole groups, and bootstraps by running sums against drawn rows."""

import random
import time

import numpy as np
import pytest
from driftwell.operators import inference as I
from driftwell.operators import ranks as K
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


@pytest.fixture(scope="module")
def rows(spark):
    """One group with nine tenths of the rows, ties, nulls and a null group."""
    rng = random.Random(4)
    data = [(k, "big" if k % 10 else rng.choice(["a", None, "c"]), None if k % 97 == 0 else round(rng.random() ** 3, 2), rng.randint(0, 1)) for k in range(3000)]
    return spark.createDataFrame(data, "id long, g string, p double, y int")


def same(a, b):
    key = lambda r: tuple((v is not None, v) for v in r)
    left, right = (sorted(map(tuple, x.select(sorted(x.columns)).collect()), key=key) for x in (a, b))
    assert len(left) == len(right)
    for x, y in zip(left, right):
        assert all(u == v or u == pytest.approx(v, rel=1e-12) for u, v in zip(x, y)), (x, y)


@pytest.mark.parametrize("parts", [1, 7, 40])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_ranges_equal_windows(rows, parts, by):
    same(K.auc(rows, "p", "y", by, parts), I.auc(rows, "p", "y", by))
    family = rows.select(*by, "id", "p")
    same(K.benjamini_hochberg(family, "p", by, parts=parts), I.benjamini_hochberg(family, "p", by))
    order = [F.desc("p"), F.col("id")]
    same(K.ranked(rows, by, order, parts=parts), rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))))


def test_no_partition_holds_a_large_group(rows):
    parts = K.ranged(rows, ["g"], [F.col("p"), F.col("id")], 20).groupBy("_part").count().collect()
    assert max(r["count"] for r in parts) < 2.5 * rows.count() / 20


def test_of_no_rows(rows):
    none = rows.limit(0)
    assert K.ranked(none, ["g"], [F.col("id")]).count() == 0 and K.benjamini_hochberg(none, "p", ["g"]).count() == 0
    assert K.auc(none, "p", "y", ["g"]).count() == 0


@pytest.mark.parametrize("circular", [True, False])
def test_bootstraps_by_running_sums_equal_drawn_rows(spark, circular):
    rng = random.Random(9)
    data = [(s, t, 5.0 if s == "flat" else rng.gauss(0.1, 1), rng.gauss(0, 2)) for s, n in (("a", 400), ("b", 63), ("flat", 90), ("short", 20)) for t in range(n)]
    df = spark.createDataFrame(data, "series_id string, ts int, a double, b double")
    plain = I.block_bootstrap(df, {"mean": F.avg("a"), "sharpe": I.sharpe("a")}, ["series_id"], 60, circular=circular)
    fast = I.moment_bootstrap(df, ["a"], {"mean": F.col("mean_a"), "sharpe": I.moment_sharpe("a")}, ["series_id"], 60, circular=circular)
    want = {(r.series_id, r.metric): (r.value, r.low, r.high) for r in plain.collect()}
    got = {(r.series_id, r.metric): (r.value, r.low, r.high) for r in fast.collect()}
    assert got.keys() == want.keys() and {s for s, _ in got} == {"a", "b", "flat"}
    for k in want:
        assert all(u == v or u == pytest.approx(v, abs=1e-9) for u, v in zip(got[k], want[k])), k


def test_paired_sharpe_difference_equals_drawn_rows(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([("s", t, rng.gauss(0.2, 1), rng.gauss(0, 2)) for t in range(200)], "series_id string, ts int, a double, b double")
    got = I.sharpe_difference(df, "a", "b", ["series_id"], 80).first()
    own, drawn = I._drawn(df, ["series_id"], 80, 21, True, 7, 1)
    gaps = sorted(r.d for r in drawn.join(own, ["series_id", "_i"]).groupBy("rep").agg((I.sharpe("a") - I.sharpe("b")).alias("d")).collect())
    value = df.select((I.sharpe("a") - I.sharpe("b")).alias("d")).first().d
    share = min(sum(d <= 0 for d in gaps), sum(d >= 0 for d in gaps)) / 80
    assert len(gaps) == 80 and got.value == pytest.approx(value) and gaps[0] <= got.low <= got.high <= gaps[-1]
    assert got.p == pytest.approx(min(1.0, 2 * share)) and got.low == pytest.approx(gaps[1] + 0.975 * (gaps[2] - gaps[1]))


def test_a_long_partition_of_a_family_takes_work_in_proportion_to_its_rows(spark):
    """Before, each row looked at all later ones of its partition: minutes for these rows."""
    n, alpha = 100_000, 0.05
    df = spark.range(n).select("id", F.round(F.pow(F.pmod(F.xxhash64("id"), F.lit(100_003)) / 100_003, F.lit(8.0)), 6).alias("p"))
    began = time.time()
    got = K.benjamini_hochberg(df, "p", [], alpha, parts=1).orderBy("rank").toPandas()
    took = time.time() - began
    p, rank = got["p"].to_numpy(), np.arange(1, n + 1)
    raw = np.minimum(1.0, p * n / rank)
    assert (got["rank"].to_numpy() == rank).all() and (np.diff(p) >= 0).all()
    assert np.allclose(got["adjusted_p"], np.minimum.accumulate(raw[::-1])[::-1], rtol=1e-12)
    last = rank[p <= alpha * rank / n].max()
    assert 0 < last < n and (got["reject"].to_numpy() == (rank <= last)).all()
    assert took < 60


@pytest.mark.parametrize("parts, stretch, circular", [(1, 50_000, True), (7, 50, True), (7, 50, False)])
def test_auc_by_weights_equals_drawn_rows(spark, parts, stretch, circular, monkeypatch):
    """Few distinct scores, which go over batches and ranges, NaN and zeros of both signs, groups of several stretches, and too short ones."""
    rng, reps = random.Random(2), 40
    monkeypatch.setattr(I, "_CELLS", stretch * reps)
    data = [(g, t, rng.choice([0.0, -0.0, float("nan"), None, round(rng.random(), 1)]), rng.choice([0, 1, 1, None])) for g, n in (("a", 1500), ("b", 130), (None, 90), ("short", 40)) for t in range(n)]
    df = spark.createDataFrame(data, "g string, ts int, s double, y int")
    got = {(r.g, r.rep): (r.n_pos, r.n_neg, r.auc) for r in I.auc_replicates(df, "s", "y", ["g"], reps, 21, circular, parts=parts).collect()}
    rows, drawn = I._drawn(df.where("s is not null and y is not null and g is not null"), ["g"], reps, 21, circular, 7, 50)
    want = {(r.g, r.rep): (r.n_pos, r.n_neg, r.auc) for r in I.auc(drawn.join(rows, ["g", "_i"]), "s", "y", ["g", "rep"]).collect()}
    assert got == want and {g for g, _ in got} == {"a", "b"}


def test_draws_of_one_large_group_come_from_many_rows(spark):
    """Before, one task drew all of them, from one row, and held them in its memory."""
    sizes = spark.createDataFrame([("big", 200_000)], "g string, _n long")
    starts = I._starts(sizes, 8, 21, True, 7)
    assert starts.count() == starts.select("rep", "b").distinct().count() == 8 * 9524
    shares = [r["count"] for r in starts.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) > 1 and max(shares) < 0.6 * 8 * 9524
