"""Order statistics of groups too large for one task: rows are dealt out by ranges of their order, a group over many partitions.

A partition's rows are put in order where they lie; what precedes or follows them in other partitions comes from one row a
group and partition. Results equal those of windows over whole groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftwell.functions.columns import ratio
from driftwell.sources.shared import saved, written


def ranged(df: DataFrame, by: list[str], order: list[str | Column], parts: int | None = None) -> DataFrame:
    """df with _part, which grows with the order within each group; equal rows of the order share a partition. Written down, so that a lost task deals out alike."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(df.repartitionByRange(n, *(F.col(c) for c in by), *order).withColumn("_part", F.spark_partition_id()))


def numbered(df: DataFrame, by: list[str], order: list[str | Column], parts: int | None = None) -> DataFrame:
    """df put in order once, as ``ranged`` deals it out, with _part and _id, which numbers a partition's rows in that order without gaps."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*(F.col(c) for c in by), *order]
    rows = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    return written(rows).withColumn("_part", F.shiftright("_id", 33).cast("int"))


def carried(
    rows: DataFrame, by: list[str], before: dict[str, tuple[str, Column]] | None = None, after: dict[str, tuple[str, Column]] | None = None, whole: dict[str, tuple[str, Column]] | None = None, own: dict[str, tuple[str, Column]] | None = None
) -> DataFrame:
    """rows of ``ranged`` with aggregates of the same group's earlier partitions, later ones, all, and the row's own; each is (``sum``, ``min`` or ``max``, column)."""
    sides = (before or {}, after or {}, whole or {}, own or {})
    how = {"sum": F.sum, "min": F.min, "max": F.max}
    totals = rows.groupBy(*by, "_part").agg(*(how[f](c).alias(f"_t_{k}") for side in sides for k, (f, c) in side.items()))
    group = W.partitionBy(*by)
    past = lambda o: group.orderBy(o).rowsBetween(W.unboundedPreceding, -1)
    frames = (past("_part"), past(F.desc("_part")), group, group.orderBy("_part").rowsBetween(0, 0))
    carries = totals.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_part").alias("_at"), *(how[f](f"_t_{k}").over(frame).alias(k) for frame, side in zip(frames, sides) for k, (f, _) in side.items()))
    same = F.col("_part") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return rows.join(carries if by else F.broadcast(carries), same).drop("_at", *(f"_by_{c}" for c in by))  # without groups, one row a partition


def _here(by: list[str], order: list[str | Column]):
    return W.partitionBy(*by, "_part").orderBy(*order)


def ranked(df: DataFrame, by: list[str], order: list[str | Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """df with each row's number in its group, from 1; rows that are equal in ``order`` are numbered in any order."""
    rows = carried(ranged(df, by, order, parts), by, before={"_before": ("sum", F.lit(1))})
    return rows.withColumn(name, F.coalesce("_before", F.lit(0)) + F.row_number().over(_here(by, order))).drop("_before", "_part")


def running_sums(df: DataFrame, by: list[str], order: list[str | Column], columns: list[str], parts: int | None = None) -> DataFrame:
    """df with _i, the row's number from 0, and _s_<column>, the sum of the column over the rows before it."""
    rows = carried(ranged(df, by, order, parts), by, before={"_before": ("sum", F.lit(1))} | {f"_c_{c}": ("sum", F.col(c)) for c in columns})
    here = _here(by, order)
    past = here.rowsBetween(W.unboundedPreceding, -1)
    sums = {f"_s_{c}": F.coalesce(f"_c_{c}", F.lit(0.0)) + F.coalesce(F.sum(c).over(past), F.lit(0.0)) for c in columns}
    return rows.withColumns({"_i": F.coalesce("_before", F.lit(0)) + F.row_number().over(here) - 1} | sums).drop("_before", "_part", *(f"_c_{c}" for c in columns))


def auc(df: DataFrame, score: str, label: str, by: list[str], parts: int | None = None) -> DataFrame:
    """(by, n_pos, n_neg, auc) by average ranks, as ``inference.auc``, with the distinct scores of a group over many partitions."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    g = rows.groupBy(*by, score).agg(F.sum((F.col(label) == 1).cast("long")).alias("_p"), F.sum((F.col(label) != 1).cast("long")).alias("_q"))
    g = carried(ranged(g, by, [F.col(score)], parts), by, before={"_below": ("sum", F.col("_q"))})
    below = F.coalesce("_below", F.lit(0)) + F.coalesce(F.sum("_q").over(_here(by, [score]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = g.withColumn("_w", F.col("_p") * (below + F.col("_q") / 2)).groupBy(*by).agg(F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"), F.sum("_w").alias("_w"))
    return out.select(*by, "n_pos", "n_neg", ratio(F.col("_w"), F.col("n_pos") * F.col("n_neg")).alias("auc"))


def benjamini_hochberg(df: DataFrame, p: str, by: list[str], alpha: float = 0.05, parts: int | None = None) -> DataFrame:
    """As ``inference.benjamini_hochberg``, with a family over many partitions."""
    df = df.where(F.col(p).isNotNull())
    order = [F.col(p), *(F.col(c) for c in df.columns if c not in by and c != p)]
    rows = carried(numbered(df, by, order, parts), by, before={"_before": ("sum", F.lit(1))}, whole={"_n": ("sum", F.lit(1))}, own={"_first": ("min", F.col("_id"))})
    rows = rows.withColumn("rank", F.coalesce("_before", F.lit(0)) + F.col("_id") - F.col("_first") + 1).drop("_before", "_first", "_id")
    rows = rows.withColumns({"threshold": alpha * F.col("rank") / F.col("_n"), "adjusted_p_raw": F.least(F.lit(1.0), F.col(p) * F.col("_n") / F.col("rank"))})
    passed = F.when(F.col(p) <= F.col("threshold"), F.col("rank"))
    rows = carried(rows, by, after={"_later": ("min", F.col("adjusted_p_raw"))}, whole={"_last": ("max", passed)})
    # from the last rank on: Spark takes a frame that ends with the group anew for each of its rows
    later = F.min("adjusted_p_raw").over(_here(by, [F.desc("rank")]).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumns({"adjusted_p": F.least(later, "_later"), "reject": F.coalesce(F.col("rank") <= F.col("_last"), F.lit(False))}).drop("_n", "_part", "_later", "_last")
