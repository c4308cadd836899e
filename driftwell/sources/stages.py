"""Stages whose results are kept: a run that was stopped goes on from the first stage that has not finished."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def fingerprint(spark: SparkSession, path: str) -> list:
    """What tells whether an input is still the same: its path, bytes, files and time of change."""
    fs, at = _system(spark, path)
    summary = fs.getContentSummary(at)
    return [path, summary.getLength(), summary.getFileCount(), fs.getFileStatus(at).getModificationTime()]


def committed(spark: SparkSession, path: str, manifest: dict) -> None:
    """Writes a manifest under another name and renames it, so that it is there as a whole or not at all."""
    fs, at = _system(spark, path)
    _, draft = _system(spark, path + ".draft")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True, indent=1).encode()))
    out.close()
    if not fs.rename(draft, at) and not fs.exists(at):
        raise OSError(f"could not commit {path}")


def resumed(spark: SparkSession, folder: str, stages: list[tuple[str, Callable[..., DataFrame], dict]], inputs: list[str]) -> DataFrame:
    """The result of the last of ``stages``, (name, function of (spark, the former stage's rows, **parameters), parameters).

    Each stage's rows are a Parquet table in ``folder``, which is shared and outlives the run. A manifest of the stage's name,
    parameters, inputs and all stages before it is committed after its rows. A stage whose manifest is there is read, not run;
    a changed input, parameter, name or order changes the manifest's key, and with it that stage and those after it run again.
    Rows without a manifest, of a run that was stopped, are written over. Functions are known by their names only: give a
    changed one another name or parameter. The first stage gets None for rows.
    """
    if not stages:
        raise ValueError("no stages")
    before, rows = {"inputs": [fingerprint(spark, p) for p in inputs]}, None
    for name, function, parameters in stages:
        manifest = {"stage": name, "parameters": parameters, "before": before}
        key = hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()[:32]
        data, mark = f"{folder}/{name}-{key}", f"{folder}/{name}-{key}.json"
        fs, at = _system(spark, mark)
        if not fs.exists(at):
            function(spark, rows, **parameters).write.mode("overwrite").parquet(data)
            committed(spark, mark, manifest)
        rows, before = spark.read.parquet(data), {"key": key}
    return rows
