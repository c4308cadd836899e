"""Stages that are kept: what a stopped run has finished is not done again."""

import os
import tempfile

import pytest
from driftwell.sources.stages import resumed
from pyspark.sql import functions as F


def test_a_stopped_run_redoes_the_unfinished_stage_only(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    source, kept = f"{folder}/in", f"{folder}/kept"
    spark.range(10).write.parquet(source)
    ran, broken = [], [True]

    def read(spark, rows):
        ran.append("read")
        return spark.read.parquet(source)

    def scaled(spark, rows, by):
        ran.append("scaled")
        return rows.withColumn("x", F.col("id") * by)

    def total(spark, rows):
        ran.append("total")
        if broken[0]:
            rows.limit(3).write.mode("overwrite").parquet(f"{kept}/total-half")
            raise RuntimeError("stopped")
        return rows.agg(F.sum("x").alias("x"))

    def run(by=2):
        ran.clear()
        return resumed(spark, kept, [("read", read, {}), ("scaled", scaled, {"by": by}), ("total", total, {})], [source]).first().x

    with pytest.raises(RuntimeError):
        run()
    assert ran == ["read", "scaled", "total"]
    broken[0] = False
    assert run() == 90 and ran == ["total"]
    assert run() == 90 and ran == []
    assert run(3) == 135 and ran == ["scaled", "total"]
    assert run() == 90 and ran == []
    for mark in os.listdir(kept):
        if mark.startswith("scaled") and mark.endswith(".json"):
            os.rename(f"{kept}/{mark}", f"{folder}/{mark}")
    assert run() == 90 and ran == ["scaled"]  # rows without a manifest are those of a stopped run
    spark.range(4).write.mode("append").parquet(source)
    assert run() == 102 and ran == ["read", "scaled", "total"]


def test_no_stages_is_an_error(spark):
    with pytest.raises(ValueError):
        resumed(spark, "/tmp/none", [], [])
