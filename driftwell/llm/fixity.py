"""Merkle fixity audit of WARC records: two replicas hash their records and ordered ranges of records into trees; roots are
compared, and only branches that differ are followed down to the records and byte ranges that differ.

A record is one page. A leaf's place in the tree is 17 hexadecimal digits, in the order of keys: whole numbers of any size up to 64
bits go by value, keys of other types by a 64-bit hash, and a null key stands before all others. A node is a prefix of those digits, so a
lost or added record moves no other record to another branch, and levels above the longest common prefix are left out. A node has the
digest of its children, their bytes and their number. Byte offsets come from the trees too: going down, a child starts where
its parent starts plus the bytes of the siblings before it; nothing is summed over the whole archive.

Rows of one key are one record whose digest does not depend on their order. Null urls and pages are empty. Identical archives, and
empty ones, give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.llm.common import saved

DIGITS = 17
_END = "\r\n\r\n"
_BEGIN = "WARC/1.1\r\n"


def warc_record(id: str, url: str, body: str, date: str = "1970-01-01T00:00:00Z") -> Column:
    """The text of a WARC/1.1 resource record; ``date`` is when the page was captured, where the table doesn't tell."""
    text = F.coalesce(F.col(body), F.lit(""))
    head = [
        F.lit(f"{_BEGIN}WARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(id).cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.coalesce(F.col(url), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(text).cast("string"), F.lit(_END),
    ]
    return F.concat(*head, text, F.lit(_END))


def write_warc(records: DataFrame, path: str, record: str = "record") -> None:
    """Plain WARC files of records as ``warc_record`` makes them, a file a task."""
    body = F.expr(f"left(`{record}`, length(`{record}`) - {len(_END)})")  # the writer ends each with the same bytes
    records.select(body.alias("value")).write.option("lineSep", _END).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, url, date, body, record, valid) of the records of plain WARC files; files are split between tasks.

    Records are cut where one ends and the next begins. ``valid`` is false where the length differs from the one that the record
    declares, as when it is damaged or its body holds another archive.
    """
    lines = spark.read.option("lineSep", f"{_END}{_BEGIN}").text(path)
    text = F.regexp_replace("value", "^WARC/1\\.1\r\n|\r\n\r\n$", "")
    parts = F.split(text, _END, 2)
    field = lambda name: F.regexp_extract(parts[0], rf"(?i)(?:^|\n){name}: ?([^\r]*)", 1)
    body = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    return lines.select(
        field("WARC-Record-ID").alias("record_id"), field("WARC-Target-URI").alias("url"), field("WARC-Date").alias("date"), body.alias("body"), F.concat(F.lit(_BEGIN), text, F.lit(_END)).alias("record"),
        (F.octet_length(body).cast("string") == field("Content-Length")).alias("valid"),
    )


def place(key: Column, whole: bool) -> Column:
    """A key's digits; ``whole`` numbers have their sign turned, so that digits are in the order of values."""
    number = key.cast("long").bitwiseXOR(F.lit(-(2**63))) if whole else F.xxhash64(key.cast("string"))
    return F.when(key.isNull(), "0" * DIGITS).otherwise(F.concat(F.lit("1"), F.lpad(F.hex(number), DIGITS - 1, "0")))


def leaves(records: DataFrame, key: str, record: str) -> DataFrame:
    """(node, key, digest, bytes, records) of each key. A key of one record keeps its whole SHA-256; a null record is empty."""
    whole = isinstance(records.schema[key].dataType, T.IntegralType)
    text = F.coalesce(F.col(record), F.lit(""))
    rows = records.select(F.col(key).alias("key"), F.sha2(text, 256).alias("sha"), F.octet_length(text).cast("long").alias("size"))
    sums = rows.groupBy("key").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("records"), F.min("sha").alias("a"), F.max("sha").alias("z"),
        F.expr("bit_xor(xxhash64(sha))").alias("x"), F.sum(F.xxhash64("sha").cast("decimal(38,0)")).alias("s"),
    )
    alike = F.sha2(F.concat_ws(":", "records", "a", "z", "x", "s"), 256)
    return sums.select(place(F.col("key"), whole).alias("node"), "key", F.when(F.col("records") == 1, F.col("a")).otherwise(alike).alias("digest"), "bytes", "records")


def tree(at: DataFrame, height: int) -> list[DataFrame]:
    """(node, digest, bytes, records) of each level, from leaves to the root; the last has one node, or none."""
    levels = [at]
    for k in range(height):
        parent = F.substring("node", 1, DIGITS - k - 1)
        up = at.groupBy(parent.alias("parent")).agg(F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("c"), F.sum("bytes").alias("bytes"), F.sum("records").alias("records"))
        text = F.array_join(F.transform("c", lambda x: F.concat_ws("=", x["node"], x["digest"])), ",")
        at = saved(up.select(F.col("parent").alias("node"), F.sha2(text, 256).alias("digest"), "bytes", "records"))
        levels.append(at)
    return levels


def _below(level: DataFrame, parents: DataFrame, side: str, digits: int) -> DataFrame:
    """The children of nodes that differ, each with its byte offset."""
    child = level.withColumn("parent", F.substring("node", 1, digits - 1))
    met = child.join(parents.select(F.col("node").alias("parent"), F.col(f"{side}_offset").alias("begin")), "parent")
    before = W.partitionBy("parent").orderBy("node").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce("begin", F.lit(0)) + F.coalesce(F.sum("bytes").over(before), F.lit(0))
    return met.select("node", *(F.col(c).alias(f"{side}_{c}") for c in ("digest", "bytes", "records")), offset.alias(f"{side}_offset"))


def audit(first: DataFrame, second: DataFrame, key: str = "page_id", record: str = "record") -> DataFrame:
    """(key, kind, offset and bytes in either replica) of each record that differs: changed, missing (from the second) or added."""
    a, b = (saved(leaves(x, key, record)) for x in (first, second))
    ends = a.select("node").union(b.select("node")).agg(F.min("node").alias("low"), F.max("node").alias("high")).first()
    low, high = ends["low"] or "0" * DIGITS, ends["high"] or "0" * DIGITS
    common = next((k for k in range(DIGITS) if low[k] != high[k]), DIGITS - 1)
    height = DIGITS - common
    ta, tb = tree(a, height), tree(b, height)
    top = lambda t, s: t[-1].select("node", *(F.col(c).alias(f"{s}_{c}") for c in ("digest", "bytes", "records")), F.lit(0).cast("long").alias(f"{s}_offset"))
    differ = ~F.col("a_digest").eqNullSafe(F.col("b_digest"))
    found = top(ta, "a").join(top(tb, "b"), "node", "full").where(differ)
    for k in range(height - 1, -1, -1):
        found = saved(_below(ta[k], found, "a", DIGITS - k).join(_below(tb[k], found, "b", DIGITS - k), "node", "full").where(differ))
    keys = a.select("node", F.col("key").alias("a_key")).join(found, "node", "right").join(b.select("node", F.col("key").alias("b_key")), "node", "left")
    kind = F.when(F.col("b_digest").isNull(), "missing").when(F.col("a_digest").isNull(), "added").otherwise("changed")
    there = lambda s, name: [F.when(F.col(f"{s}_digest").isNotNull(), F.col(f"{s}_{c}")).alias(f"{name}_{c}") for c in ("offset", "bytes")]
    return keys.select(F.coalesce("a_key", "b_key").alias(key), kind.alias("kind"), *there("a", "first"), *there("b", "second"))
