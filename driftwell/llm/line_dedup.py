"""Lines found in many documents, by levelled sorted runs of line hashes.

A run holds (h1, h2, n): the 128-bit hash of a line's key and the number of documents of a batch that have it. It is a table
bucketed and sorted by the hash, so runs and batches meet in merge joins that move nothing. A new batch is joined with the runs,
the keys that they already count to the threshold are left out, since more of them decide nothing, and the rest becomes a run of its
own. When a level has ``fanout`` runs they are merged into one of the next level, so that a key is rewritten a logarithmic number of
times, and later batches meet fewer runs.

A line's key is the line without white space at both ends, A-Z lower-cased. Lines with an empty key are never counted.
A null text is one empty line. Rows of the same text count as so many documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.common import bucketed, dropped, line_keys, saved, setting, slices, small_batches

KEY = ("h1", "h2")


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sorted_scans(spark: SparkSession):
    """Buckets of one sorted file each, as runs are written, are read as sorted, so merge joins of runs sort nothing."""
    return setting(spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true")


class LineRuns:
    """The runs of a store, as bucketed tables below a folder that all executors share."""

    def __init__(self, spark: SparkSession, threshold: int = 10, fanout: int = 3, buckets: int | None = None):
        self.spark, self.threshold, self.fanout, self.buckets = spark, threshold, fanout, buckets or _parts(spark)
        self.levels: list[list[tuple[DataFrame, list]]] = [[]]

    def _write(self, counts: DataFrame, level: int) -> None:
        made: list[tuple[str, str]] = []
        self.levels[level].append((bucketed(counts, self.buckets, KEY, made, KEY), made))

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Runs one after the other, their counts added up."""
        out = runs[0].select(*KEY, "n")
        for run in runs[1:]:
            out = out.join(run.select(*KEY, F.col("n").alias("m")), list(KEY), "full").select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run, _ in level]

    def frequent(self) -> DataFrame:
        """(h1, h2, n) of keys in at least ``threshold`` documents so far, n being as many of them as were counted."""
        if not self.runs():
            return self.spark.createDataFrame([], "h1 long, h2 long, n long")
        return self._merged(self.runs()).where(F.col("n") >= self.threshold)

    def add(self, counts: DataFrame) -> None:
        """A batch's (h1, h2, n), bucketed as the runs are or in any other order."""
        counts = counts.select(*KEY, "n")
        seen = F.lit(0)
        for k, run in enumerate(self.runs()):
            counts = counts.join(run.select(*KEY, F.col("n").alias(f"n{k}")), list(KEY), "left")
            seen = seen + F.coalesce(f"n{k}", F.lit(0))
        self._write(counts.where(seen < self.threshold).select(*KEY, "n"), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self._write(self._merged([run for run, _ in self.levels[level]]), level + 1)
            for _, made in self.levels[level]:
                dropped(self.spark, made)
            self.levels[level] = []
            level += 1

    def drop(self) -> None:
        for level in self.levels:
            for _, made in level:
                dropped(self.spark, made)
        self.levels = [[]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice: its distinct keys by batch number and how many of its documents have them."""
    for batch in batches:
        part, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        for a, b in slices(texts):
            h1, h2, first = line_keys(texts.slice(a, b - a))
            doc = np.repeat(np.arange(a, b), np.diff(first))
            full = h2 != 0
            h1, h2, doc = h1[full], h2[full], doc[full]
            order = np.lexsort((doc, h2, h1))
            h1, h2, doc = h1[order], h2[order], doc[order]
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (doc[1:] != doc[:-1])
            h1, h2, which = h1[new], h2[new], part[doc[new]]
            order = np.lexsort((which, h2, h1))
            h1, h2, which = h1[order], h2[order], which[order]
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (which[1:] != which[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(h1)))
            yield pa.RecordBatch.from_arrays([pa.array(which[at], pa.int32()), pa.array(h1[at]), pa.array(h2[at]), pa.array(n, pa.int64())], names=["batch", "h1", "h2", "n"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line's place in its text, by the text's hashes."""
    for batch in batches:
        t1, t2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        texts = batch.column(2)
        for a, b in slices(texts):
            h1, h2, first = line_keys(texts.slice(a, b - a))
            runs = np.diff(first)
            doc = np.repeat(np.arange(a, b), runs)
            place = np.arange(len(h1)) - np.repeat(first[:-1], runs)
            full = h2 != 0
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t1[doc][full], t2[doc][full], place[full].astype(np.int32), h1[full], h2[full])], names=["t1", "t2", "place", "h1", "h2"])


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, places to drop, gives way to the text that stays and the lines dropped from it."""
    for batch in batches:
        at = batch.schema.get_field_index("_text")
        drops = batch.column(batch.schema.get_field_index("_drop"))
        kept, lines, dropped = [], [], []
        for text, drop in zip(batch.column(at).to_pylist(), drops.to_pylist()):
            lines.append(text.count("\n") + 1 if text else 1)
            if drop:
                gone = set(drop)
                text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
            kept.append(text)
            dropped.append(len(drop) if drop else 0)
        rest = [k for k, name in enumerate(batch.schema.names) if name not in ("_text", "_drop")]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*(batch.schema.names[k] for k in rest), "kept_text", "n_lines", "n_dropped"])


def line_counts(docs: DataFrame, text: str = "text", batches: int = 4) -> DataFrame:
    """(batch, h1, h2, n) of all documents, dealt by key; a text's hash picks its batch.

    The batches' counts are columns until keys are dealt out, so that each task adds up its own slices before: a line of all
    documents sends one row a task.
    """
    small_batches(docs.sparkSession)
    deal = docs.select(F.pmod(F.xxhash64(text), F.lit(batches)).cast("int").alias("batch"), F.col(text).cast("string").alias("text"))
    found = deal.mapInArrow(_counted, "batch int, h1 long, h2 long, n long")
    by_batch = [F.sum(F.when(F.col("batch") == b, F.col("n"))).alias(f"n{b}") for b in range(batches)]
    added = found.groupBy(*KEY).agg(*by_batch)
    return added.select(*KEY, F.posexplode(F.array(*(f"n{b}" for b in range(batches)))).alias("batch", "n")).where("n is not null").select("batch", *KEY, "n")


def frequent_lines(docs: DataFrame, text: str = "text", threshold: int = 10, batches: int = 4) -> DataFrame:
    """(h1, h2, n) of lines in ``threshold`` documents or more, counted by batches."""
    spark, made = docs.sparkSession, []
    counts = bucketed(line_counts(docs, text, batches), _parts(spark), KEY, made, KEY)
    runs = LineRuns(spark, threshold)
    with sorted_scans(spark):
        for b in range(batches):
            runs.add(counts.where(F.col("batch") == b))
        found = saved(runs.frequent())
    runs.drop()
    dropped(spark, made)
    return found


def drop_frequent_lines(docs: DataFrame, text: str = "text", threshold: int = 10, batches: int = 4) -> DataFrame:
    """``docs`` with kept_text, the text without lines found in ``threshold`` documents or more, n_lines before and n_dropped.

    Columns of ``docs`` keep their names and order; one that is called like a new one gives way to the new one.
    A null text stays null.
    """
    docs = docs.drop(*({"kept_text", "n_lines", "n_dropped"} & set(docs.columns) - {text}))
    frequent = frequent_lines(docs, text, threshold, batches)
    names = docs.columns
    keyed = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)), F.col(f"`{text}`").cast("string").alias("_text"))
    keyed = keyed.withColumns({"_t1": F.xxhash64("_text"), "_t2": F.xxhash64(F.lit(1), "_text")})
    lines = keyed.select(F.col("_t1").alias("t1"), F.col("_t2").alias("t2"), "_text").mapInArrow(_placed, "t1 long, t2 long, place int, h1 long, h2 long")
    # a line with more than a quarter of a task's share of all frequent lines is dealt to several tasks by its texts; there are four a task at most
    share = frequent.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / (4 * _parts(docs.sparkSession))
    ways = F.ceil(F.col("n") / F.lit(max(share, 1.0))).cast("int")
    hot = F.broadcast(frequent.where(ways > 1).select(*KEY, ways.alias("ways")))
    lines = lines.join(hot, list(KEY), "left").withColumn("salt", F.pmod("t1", F.coalesce("ways", F.lit(1))).cast("int")).drop("ways")
    frequent = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), ways - 1))).drop("n")
    # written, so that the join below is of two plain shuffles and Spark can split a text that very many rows have
    drops = saved(lines.join(frequent, [*KEY, "salt"]).groupBy("t1", "t2").agg(F.collect_set("place").alias("_drop")))
    own = [f"c{k}" for k, c in enumerate(names) if c != text]
    joined = keyed.join(drops, (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2")), "left").select(*own, "_text", "_drop")
    kinds = dict(keyed.dtypes)
    done = joined.mapInArrow(_stripped, ", ".join([*(f"{c} {kinds[c]}" for c in own), "kept_text string, n_lines long, n_dropped long"]))
    out = {f"c{k}": c for k, c in enumerate(names)}
    return done.select(*(F.col(c).alias(out[c]) for c in own), "kept_text", "n_lines", "n_dropped")
