"""Ranked lexical search: the best documents for each item, by a K2-treap over the grid of terms and documents.

1. One scan cuts documents into terms and writes, for each, its length and the items' terms in it with their counts. From that table
   come the number of documents with terms, their mean length and each term's document frequency, so weights cover all documents.
2. Each task reads its documents in blocks, ordered by id. A block is a grid whose rows are terms, by falling document frequency,
   and whose columns are documents; a cell holds the impact of the term in the document. The grid is a compressed quadtree: a node is a
   square that is not empty, four bits say which of its quarters are not, and its value is the greatest impact below.
3. All items descend together. An item's state is a set of document ranges, each with the nodes of its terms' rows at that level; the bound
   of a range is the sum of weight and node value over them. The ranges with the highest bounds are halved first: each node gives way to the
   quarter of its row in either half, or to nothing. A range of one document has its bound as exact score. Ranges whose bound is
   below an item's tenth score so far are dropped; that score holds over all blocks of a task, so later blocks are mostly dropped at once.
4. Tasks return their best; the best of all follow in two steps of windows, so no group is longer than tasks times ``k`` by the square root of tasks.

A term's weight w is floor(1000 ln((2 N + 2) / (2 df + 1))); a document's m is 10 + 90 n N div L, and a term adds
w (10^9 tf div (1000 tf + 8 m)), in 64-bit integers. Terms are the longest stretches of digits, ASCII letters and characters beyond ASCII, A-Z lower-cased; they are
compared by 64-bit hashes. Items go in blocks of some ``pairs`` pairs of item and term, which bounds what is sent to the tasks (16 bytes a pair).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.llm.common import saved, slices, small_batches, word_hashes, written

_TERMS = np.zeros(256, np.uint8)
_TERMS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
#: Documents of a block, and paths that are followed at once.
BLOCK, PATHS = 4096, 1 << 17


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all terms, and each text's first one."""
    hashes, first = word_hashes(texts, kinds=_TERMS)
    return hashes.view(np.int64), first


def _spread(bits: np.ndarray) -> np.ndarray:
    """The bits of a number below 2^31, with a gap after each."""
    x = bits.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


_ONES = np.array([bin(k).count("1") for k in range(16)], np.int64)


class Treap:
    """A grid of cells (row, column, value > 0) as a compressed quadtree with the greatest value of each node.

    Nodes are numbered level by level from the root, 0. ``quarters`` has four bits a node, by row half and column half, and ``child`` the number of
    its first quarter: the others follow, so a quarter is found by counting the bits before it.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray):
        self.depth = max(1, int(max(rows.max(initial=0), columns.max(initial=0))).bit_length())
        code = (_spread(rows) << np.uint64(1)) | _spread(columns)
        order = np.argsort(code, kind="stable")
        code, value = code[order], values[order]
        levels = [(np.zeros(len(code), np.uint8), value)]
        for _ in range(self.depth):
            up = code >> np.uint64(2)
            new = np.flatnonzero(np.append(True, up[1:] != up[:-1]))
            bits = np.bitwise_or.reduceat(np.uint8(1) << (code & np.uint64(3)).astype(np.uint8), new)
            code, value = up[new], np.maximum.reduceat(value, new)
            levels.append((bits, value))
        levels.reverse()
        self.quarters, self.value = (np.concatenate([x[k] for x in levels]) for k in (0, 1))
        self.child = 1 + np.cumsum(_ONES[self.quarters]) - _ONES[self.quarters]

    def quarter(self, node: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The numbers of those quarters, -1 where they are empty."""
        bits, at = self.quarters[node], (row * 2 + column).astype(np.uint8)
        there = (bits >> at) & np.uint8(1) == 1
        before = _ONES[bits & ((np.uint8(1) << at) - np.uint8(1))]
        return np.where(there, self.child[node] + before, -1)


class Best:
    """The ``k`` highest scores of each item so far, ties in the order of the documents' numbers."""

    def __init__(self, items: int, k: int):
        self.k, self.items = k, items
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.zeros(items, np.int64)  # the k-th score, if there are so many, and its document
        self.last = np.zeros(items, np.int64)

    def may(self, item: np.ndarray, bound: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a score of ``bound`` at most, of documents from ``doc`` on, can be among the best."""
        return (bound > self.least[item]) | (bound == self.least[item]) & (doc < self.last[item])

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = np.concatenate([self.item, item]), np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = (rank < self.k) & (score > 0)
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]
        last = keep & (rank == self.k - 1)
        self.least[item[last]], self.last[item[last]] = score[last], doc[last]


def _taken(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of all those ranges, one after the other."""
    return np.arange(int(counts.sum())) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def descend(treap: Treap, item: np.ndarray, row: np.ndarray, weight: np.ndarray, best: Best, base: int, width: int = 8) -> None:
    """Adds the best columns for all items, whose (item, row, weight) are sorted by item. Columns are numbered from ``base`` on.

    In each round every item's ``width`` highest ranges are halved, twice as many in the next, until some ``PATHS`` paths are followed at once.
    """
    if not len(item) or not len(treap.value):
        return
    # ranges: item, level, column, bound, and where their (node, row, weight) are
    own, start = np.unique(item, return_index=True)
    count = np.diff(np.append(start, len(item)))
    bound = np.add.reduceat(weight * treap.value[0], start)
    pool = np.stack([own, np.zeros_like(own), np.zeros_like(own), bound, start, count])
    node, paths = np.zeros(len(item), np.int64), len(item)
    arena = [x.astype(np.int32) for x in (node, row, weight)]
    widest = max(width, PATHS // paths)
    while True:
        pool = pool[:, best.may(pool[0], pool[3], base + (pool[2] << (treap.depth - pool[1])))]
        if not pool.shape[1]:
            return
        pool = pool[:, np.lexsort((-pool[3], pool[0]))]
        first = np.arange(pool.shape[1]) - np.searchsorted(pool[0], pool[0]) < width
        now, pool = pool[:, first], pool[:, ~first]
        at = _taken(now[4], now[5])
        of = np.repeat(np.arange(now.shape[1]), now[5])
        node, row, weight = (x[at].astype(np.int64) for x in arena)
        half = (row >> (treap.depth - 1 - now[1][of])) & 1
        # left halves, then right ones, of each range
        node = np.concatenate([treap.quarter(node, half, np.full_like(half, side)) for side in (0, 1)])
        of, row, weight = np.concatenate([2 * of, 2 * of + 1]), np.tile(row, 2), np.tile(weight, 2)
        there = np.flatnonzero(node >= 0)
        there = there[np.argsort(of[there], kind="stable")]
        node, of, row, weight = node[there], of[there], row[there], weight[there]
        fresh, start = np.unique(of, return_index=True)
        bound = np.add.reduceat(weight * treap.value[node], start) if len(of) else start
        new = np.stack([now[0][fresh // 2], now[1][fresh // 2] + 1, now[2][fresh // 2] * 2 + fresh % 2, bound, start, np.diff(np.append(start, len(of)))])
        done = new[1] == treap.depth
        best.add(new[0][done], new[3][done], base + new[2][done])
        new = new[:, ~done & best.may(new[0], new[3], base + (new[2] << (treap.depth - new[1])))]
        # what new ranges hold goes behind what is there; where that is full, what no range needs any more goes first
        at = _taken(new[4], new[5])
        more = len(at)
        if paths + more > len(arena[0]):
            pool = pool[:, best.may(pool[0], pool[3], base + (pool[2] << (treap.depth - pool[1])))]
            need = _taken(pool[4], pool[5])
            pool[4], paths = np.cumsum(pool[5]) - pool[5], len(need)
            arena = [np.concatenate([x[need], np.zeros(paths + more, np.int32)]) for x in arena]
        for x, y in zip(arena, (node, row, weight)):
            x[paths : paths + more] = y[at]
        new[4] = paths + np.cumsum(new[5]) - new[5]
        paths, width = paths + more, min(2 * width, widest)
        pool = np.concatenate([pool, new], axis=1)


def _counted(terms):
    """(n, terms, tfs) of each text: all its terms' number, those of the items as numbers in ``terms``, and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = terms.value
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts):
                hashes, first = term_hashes(texts.slice(a, b - a))
                at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
                hit = own[at] == hashes
                doc = np.repeat(np.arange(b - a), np.diff(first))[hit]
                pair, n = np.unique(doc * len(own) + at[hit], return_counts=True)
                offsets = pa.array(np.searchsorted(pair // len(own), np.arange(b - a + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(pair % len(own), pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64()))],
                    names=["doc", "n", "terms", "tfs"],
                )

    return run


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """What a term adds to a score, before its weight, in a document of ``n`` terms; of ``docs`` documents with ``length`` terms in all."""
    m = 10 + 90 * n * docs // length
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` or some more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _searched(items, docs: int, length: int, k: int):
    """(item, doc, score) of a task's best. Documents come in the order of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, row, weight, row_of, count = items.value
        best, base, ids, kind = Best(count, k), 0, {}, None
        for batch in _blocks(batches, BLOCK):
            kind = batch.schema.field(0).type
            offsets = batch.column(2).offsets.to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            rows, tf = row_of[batch.column(2).flatten().to_numpy()], batch.column(3).flatten().to_numpy()
            value = impacts(tf, batch.column(1).to_numpy()[doc], docs, length)
            here = np.zeros(len(row_of), bool)
            here[rows] = True
            mine = here[row]
            if value.any():
                some = value > 0
                descend(Treap(rows[some], doc[some], value[some]), item[mine], row[mine], weight[mine], best, base)
            ids = {d: ids[d] if d < base else batch.column(0)[d - base].as_py() for d in best.doc.tolist()}
            base += batch.num_rows
        if kind is not None and len(best.doc):
            yield pa.RecordBatch.from_arrays([pa.array(best.item, pa.int64()), pa.array([ids[d] for d in best.doc.tolist()], kind), pa.array(best.score, pa.int64())], names=["item", "doc", "score"])

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, first = term_hashes(batch.column(1))
        item = np.repeat(batch.column(0).to_numpy(), np.diff(first))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(hashes)], names=["item", "term"])


def _best_of(found: DataFrame, k: int) -> DataFrame:
    """The best of all tasks: first of parts of them, then of those."""
    parts = max(1, math.isqrt(found.rdd.getNumPartitions()))
    order = (F.desc("score"), F.asc("doc"))
    found = found.withColumn("part", F.spark_partition_id() % parts)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).drop("part")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", pairs: int = 500_000) -> DataFrame:
    """(item id, rank, id, score) of each item's ``k`` best documents, by score, then by id; documents without any of its terms are none.

    Each row of ``docs`` is a document, repeated ones too. Items of the same id and text count once; those of a null text or without terms find nothing, and so do items
    where no document has terms. Ids may be null and of any type that Spark can order; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id).alias("doc"), F.col(text).cast("string").alias("text"))
    kind, item_kind = docs.schema["doc"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    items = saved(items.select(F.col(item_id).alias("id"), F.col(item_text).cast("string").alias("text")).distinct().withColumn("item", F.monotonically_increasing_id()))
    terms = saved(items.select("item", "text").mapInArrow(_item_terms, "item long, term long").distinct())
    out = spark.createDataFrame([], f"id {item_kind}, rank int, doc {kind}, score long")
    blocks = -(-terms.count() // pairs)
    for block in range(blocks):
        some = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).orderBy("item", "term").toArrow()  # some ``pairs`` rows, not all of them
        found = _found(spark, docs, kind, some.column("item").to_numpy(), some.column("term").to_numpy(), k)
        if found is not None:
            out = out.union(found.join(items, "item").select("id", "rank", "doc", "score"))
    return out.select(F.col("id").alias(item_id), "rank", F.col("doc").alias(id), "score")


def _found(spark: SparkSession, docs: DataFrame, kind: str, item: np.ndarray, term: np.ndarray, k: int) -> DataFrame | None:
    """(item, rank, doc, score) of the items of one block."""
    if not len(item):
        return None
    context = spark.sparkContext
    own = np.unique(term)
    cells = written(docs.mapInArrow(_counted(context.broadcast(own)), f"doc {kind}, n long, terms array<int>, tfs array<long>"))
    count, length = cells.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not count:
        return None
    df = np.zeros(len(own), np.int64)
    for r in cells.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term of the block
        df[r["term"]] = r["count"]
    row_of = np.empty(len(own), np.int64)
    row_of[np.argsort(-df, kind="stable")] = np.arange(len(own))
    weight = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    numbers, which = np.unique(item, return_inverse=True)
    at = np.searchsorted(own, term)
    use = weight[at] > 0
    sent = context.broadcast((which[use], row_of[at[use]], weight[at[use]], row_of, len(numbers)))
    best = cells.where(F.size("terms") > 0).sortWithinPartitions("doc").mapInArrow(_searched(sent, count, length, k), f"item long, doc {kind}, score long")
    names = spark.createDataFrame(pa.table({"item": np.arange(len(numbers)), "number": numbers}))
    return _best_of(best, k).join(names, "item").select(F.col("number").alias("item"), "rank", "doc", "score")
