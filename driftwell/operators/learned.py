"""Signals learned walk-forward with pyspark.ml."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftwell.operators.blocks import saved


def _folds(df: DataFrame, features: list[str], train: int, refit: int) -> tuple[DataFrame, list[int]]:
    days = df.select("ts").distinct().withColumn("day", F.row_number().over(W.partitionBy().orderBy("ts")) - 1)  # one row a date
    rows = saved(df.dropna(subset=features).join(days, "ts"))
    last = rows.agg(F.max("day")).first()[0]
    starts = list(range(train, last + 1, refit)) if last is not None else []
    return rows, starts


def walk_forward(df: DataFrame, features: list[str], target: str, model: str = "gbt", train: int = 252, refit: int = 21, embargo: int = 5, rounds: int = 50, depth: int = 3) -> DataFrame:
    """(series_id, ts, fold, probability, prediction, target) for each test day: a model of all rows before the fold, less ``embargo`` days whose target looks into it.

    gbt: P(target = 1) by boosted trees. logistic: the class of a multinomial model. Rows with a null target are not learned
    from; a fold whose training rows have one class is left out. Features are scaled on training rows only.
    """
    rows, starts = _folds(df, features, train, refit)
    assemble = VectorAssembler(inputCols=features, outputCol="_raw")
    out = None
    for fold, start in enumerate(starts):
        own = assemble.transform(rows.where(F.col(target).isNotNull() & (F.col("day") < start - embargo)))
        if own.select(target).distinct().limit(2).count() < 2:
            continue
        scale = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(own)
        if model == "gbt":
            learner = GBTClassifier(labelCol=target, featuresCol="_x", maxIter=rounds, maxDepth=depth, stepSize=0.05, subsamplingRate=0.8, seed=1)
        else:
            learner = LogisticRegression(labelCol=target, featuresCol="_x", family="multinomial", maxIter=rounds)
        test = scale.transform(assemble.transform(rows.where((F.col("day") >= start) & (F.col("day") < start + refit))))
        told = learner.fit(scale.transform(own)).transform(test)
        told = told.select("series_id", "ts", F.lit(fold).alias("fold"), vector_to_array("probability")[1].alias("probability"), F.col("prediction").cast("int").alias("prediction"), F.col(target).alias("target"))
        out = told if out is None else out.unionByName(told)
    if out is None:
        return rows.select("series_id", "ts", F.lit(0).alias("fold"), F.lit(0.0).alias("probability"), F.lit(0).alias("prediction"), F.col(target).alias("target")).limit(0)
    return out


def conviction(df: DataFrame, low: float = 0.4, high: float = 0.6) -> DataFrame:
    """weight = 2 (p - 0.5) where p is outside [low, high], else 0."""
    p = F.col("probability")
    return df.withColumn("weight", F.when((p < low) | (p > high), 2 * (p - 0.5)).otherwise(0.0))
