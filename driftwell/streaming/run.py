"""Runs a stream over what its source has now, and gives the sink's table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.sources.shared import new_folder

#: The store of state that keeps lists and timers, which recursions need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; event time has to be a timestamp with a time zone."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = spark.readStream.schema(table.schema)
    if any(f.endswith("/events.parquet") for f in table.inputFiles()):  # one file, beside those of other tables
        source = source.option("pathGlobFilter", "events.parquet")
        at = sf_dir
    else:
        at = f"{sf_dir}/events.parquet"
    return source.parquet(at).withColumn("ts", F.col("ts").cast("timestamp"))


def available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that the source has now, through a Parquet sink with its own checkpoint.

    Operators that wait for the watermark keep what lies behind the last one: those rows come out when later events arrive, and
    not in a run that ends with the source.
    """
    spark, at = stream.sparkSession, new_folder(stream.sparkSession, "stream")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
