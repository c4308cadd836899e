"""Long panels: (series_id, ts, price, volume, dollar_volume, ret, logret)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.operators.cleaning import log_return, simple_return
from driftwell.sources.tables import table


def wide_csv(spark: SparkSession, path: str, series: list[str], end: str | None = None, date: str = "Date", value: str = "price") -> DataFrame:
    """A CSV with a column a series as a long table, read with a fixed schema and cut after ``end``."""
    schema = ", ".join([f"`{date}` date", *(f"`{s}` double" for s in series)])
    df = spark.read.csv(path, schema=schema, header=True)
    df = df.where(F.col(date) <= F.lit(end).cast("date")) if end else df
    return df.unpivot([date], series, "series_id", value).withColumnRenamed(date, "ts")


def universe(prices: DataFrame, volumes: DataFrame) -> DataFrame:
    """Prices with the volumes of the same series and day, dollar volume and returns; a null price gives a null return on its day and the next."""
    df = prices.join(volumes, ["series_id", "ts"], "left")
    return log_return(simple_return(df.withColumn("dollar_volume", F.col("price") * F.col("volume"))))


def snapshot(spark: SparkSession, path: str, build) -> DataFrame:
    """What ``build()`` gives, from the Parquet at ``path`` where it is, else written there first."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.parquet(path)
    return spark.read.parquet(path)


def type_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean unit price, quantity and revenue of each part type and shipping day, with returns."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
    df = items.join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    df = df.groupBy(F.col("p_type").alias("series_id"), F.to_date("l_shipdate").alias("ts")).agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.sum("l_quantity").alias("volume"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("dollar_volume"),
    )
    return log_return(simple_return(df))


def brand_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by brand and week."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
    df = items.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    df = df.groupBy(F.col("p_brand").alias("series_id"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("ts")).agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.sum("l_quantity").alias("volume"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("dollar_volume"),
    )
    return log_return(simple_return(df))


def segment_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order total of each market segment and day; days are missing."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    df = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    df = df.groupBy(F.col("c_mktsegment").alias("series_id"), F.to_date("o_orderdate").alias("ts")).agg(F.avg("o_totalprice").alias("price"))
    return log_return(simple_return(df))


def monthly_order_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order total of each month, as a macro series."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("ts")).agg(F.avg("o_totalprice").alias("value"))


def coverage_summary(panel: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Rows and first and last date of each series; an expected series (series_id) without rows has 0."""
    found = panel.groupBy("series_id").agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    if expected is None:
        return found
    return expected.select("series_id").distinct().join(found, "series_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)).cast("long"))


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """A result table as Parquet, CSV (with a header) or JSON."""
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if form == "csv" else writer.format(form).save(path)


def json_summary(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("summary"))
