"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame expressions only.

An item with n distinct shingles is contained in a text to the degree c if a share c of them is in the text. Items are
partitioned by size: a partition has the items of up to ``top`` shingles, a power of two, and more than half of that. Its MinHash
signatures are the ``width`` least hashes of an item's shingles, width = top - ceil(t top) + 1. A text that contains a share t of an item
misses n - ceil(t n) of its shingles at most, which is less than width, so it has one of the signature at least: searching texts
of any length by signatures loses no match.

1. The signatures of all partitions are one table (hash, item). Each text's window hashes meet it in a join: by broadcast where the
   table takes ``broadcast_bytes`` at most, which is added up first, and by a shuffle beyond. What comes out is (text, item), once each.
2. Only texts that were found are read again; each is verified by the exact share of each of its items' shingles.

Two scans of the texts, however long the benchmark is. Texts are named by a 128-bit hash, so ids may be null, repeated or of any type.

Words are cut at white space and lower-cased. Items of fewer than ``size`` words are one shingle of all their words, looked
for among windows of that length. Items without words match nothing; null and empty texts contain nothing. Each row of
``docs`` and each row of ``items`` that match give a row, repeated ones too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import SPACE, held, saved

#: A side of a join is broadcast up to so many bytes of values.
BROADCAST = 32_000_000
_BLANK = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The lower-cased words of a text; null texts have none."""
    ink = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_BLANK))
    return F.when(ink == "", F.array().cast("array<string>")).otherwise(F.split(ink, SPACE))


def signatures(items: DataFrame, id: str = "item_id", text: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(item, words, top, shingles, signature) of each item with words; words of a shingle, and the partition's largest size."""
    df = items.select(F.col(id).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    width = F.least(F.size("w"), F.lit(size))
    by_width = F.array(*(_window_hashes_of(k)(F.col("w")) for k in range(1, size + 1)))
    df = df.select("item", width.alias("words"), F.sort_array(F.array_distinct(F.element_at(by_width, width))).alias("shingles"))
    df = df.withColumn("top", F.pow(F.lit(2.0), F.ceil(F.log2(F.size("shingles")) - 1e-9)).cast("int"))
    return df.withColumn("signature", F.slice("shingles", 1, F.col("top") - F.ceil(F.col("top") * F.lit(threshold) - 1e-9).cast("int") + 1))


def _named(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumns({"_t1": F.xxhash64(F.col(text).cast("string")), "_t2": F.xxhash64(F.lit(1), F.col(text).cast("string"))})


def held_bytes(df: DataFrame) -> int:
    """The bytes of all values of ``df``: eight a number, and a list's or text's own."""
    own = F.lit(16)
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        own = own + (F.coalesce(F.size(c), F.lit(0)) * 8 if kind.startswith("array") else F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.lit(8))
    return df.agg(F.coalesce(F.sum(own.cast("long")), F.lit(0))).first()[0]


def _small(df: DataFrame, most: int) -> DataFrame:
    """``df``, to be broadcast if it takes so many bytes at most."""
    return F.broadcast(df) if held_bytes(df) <= most else df


def _found(docs: DataFrame, text: str, items: DataFrame, size: int, threshold: float, broadcast_bytes: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """The items with their numbers, (t1, t2, rows) of texts and the items that they may contain, and the widths of shingles."""
    items = saved(items.withColumn("row", F.monotonically_increasing_id()))
    widths = sorted(r["words"] for r in items.select("words").distinct().collect())  # ``size`` numbers at most
    hashes = _small(items.select("row", F.explode("signature").alias("hash")), broadcast_bytes)
    texts = _named(docs.select(F.col(text).cast("string").alias("text")), "text").select("_t1", "_t2", F.explode(_windows(F.col("text"), widths)).alias("hash"))
    pairs = texts.join(hashes, "hash").select("_t1", "_t2", "row").distinct()
    return items, saved(pairs.groupBy("_t1", "_t2").agg(F.collect_list("row").alias("_rows"))), widths


def _windows(text: Column, widths: list[int]) -> Column:
    """Window hashes of a text, of all those widths; words are cut once."""
    hashes = [_window_hashes_of(k) for k in widths]
    return F.flatten(F.transform(F.array(words(text)), lambda w: F.concat(*(h(w) for h in hashes)))) if widths else F.array().cast("array<bigint>")


def _window_hashes_of(size: int):
    def run(w: Column) -> Column:
        n = F.size(w)
        window = lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, size)))
        return F.when(n >= size, F.transform(F.slice(w, 1, n - (size - 1)), window)).otherwise(F.array().cast("array<bigint>"))

    return run


def _verified(docs: DataFrame, text: str, items: DataFrame, found: DataFrame, widths: list[int], threshold: float, broadcast_bytes: int) -> DataFrame:
    """(columns of docs) with item, n_shared and n_item, of each row and item whose share is large enough."""
    met = _named(docs, text).join(_small(found, broadcast_bytes), ["_t1", "_t2"]).withColumn("_grams", F.array_distinct(_windows(F.col(text).cast("string"), widths)))
    met = held(met, "_grams").withColumn("row", F.explode("_rows")).drop("_rows")
    items = _small(items.select("row", "item", "shingles"), broadcast_bytes)
    n, shared = F.size("shingles"), F.size(F.array_intersect("_grams", "shingles"))
    met = met.join(items, "row").withColumns({"n_shared": shared, "n_item": n})
    return met.where(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(threshold) - 1e-9)).drop("_grams", "shingles", "row")


def contained(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 5, threshold: float = 0.8, broadcast_bytes: int = BROADCAST
) -> DataFrame:
    """(id, item id, n_shared, n_item, containment) of each row of ``docs`` and item that it contains to ``threshold`` at least."""
    docs = docs.select(F.col(id).alias("doc"), F.col(text).cast("string").alias("text"))
    items, found, widths = _found(docs, "text", signatures(items, item_id, item_text, size, threshold), size, threshold, broadcast_bytes)
    out = _verified(docs, "text", items, found, widths, threshold, broadcast_bytes)
    return out.select(F.col("doc").alias(id), F.col("item").alias(item_id), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def without_contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 5, threshold: float = 0.8, broadcast_bytes: int = BROADCAST
) -> DataFrame:
    """``docs`` without the rows that contain an item; decided by text, so ids may be null or repeated."""
    texts = docs.select(F.col(text).cast("string").alias("text"))
    items, found, widths = _found(texts, "text", signatures(items, item_id, item_text, size, threshold), size, threshold, broadcast_bytes)
    bad = saved(_verified(texts, "text", items, found, widths, threshold, broadcast_bytes).select("_t1", "_t2").distinct())
    return _named(docs, text).join(_small(bad, broadcast_bytes), ["_t1", "_t2"], "left_anti").drop("_t1", "_t2")
