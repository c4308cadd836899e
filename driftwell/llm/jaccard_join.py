"""Near-duplicate join of texts by the Jaccard similarity of their word shingles: a MinHash LSH forest with exact verification.

1. Texts with the same 128-bit hash are one class.
2. A class has ``trees`` sequences of ``deepest`` MinHash labels of 16 bits. The sequences of a tree, sorted, are its prefix trie:
   neighbours in that order share the longest prefixes. Classes whose prefix of the least depth is their own in every tree
   go no further. The least depth is the longest at which a pair at the threshold shares a prefix in some tree with probability ``recall``.
3. Candidates come from the longest prefixes first. Classes that share one are joined to the smallest of them, so that a prefix of
   any size gives no more edges than members; a component of those edges is verified by exact shingle sets, in all pairs of its blocks of
   ``block`` classes. Groups count links and return one row of each class, never the pairs.
4. Each class's recall is measured: its links stand for 1 / p links, p being the probability that a pair of that similarity shares
   a prefix so long, and one link at the threshold may always be unseen. Prefixes are shortened, by ``step`` labels, for
   classes whose recall is under the target; members of large dense groups stop early. A shorter prefix inside one verified component
   brings nothing new and is passed over; across components, only pairs of different ones are verified.
5. Components of the verified links are the classes of near duplicates.

Null, empty and blank texts have no shingle: they are linked to nothing but their own copies, with the same text. A text of
fewer than ``size`` words is one shingle. Ids are whole numbers, or what casts to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftwell.llm.common import mixed, saved, shingles, slices, small_batches, word_hashes


def forest_depth(trees: int, deepest: int, threshold: float, recall: float) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with probability ``recall``; 1 if none is."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def labels(sets: list[np.ndarray], trees: int, deepest: int) -> np.ndarray:
    """The MinHash labels of sets that are not empty: (set, tree, depth), of 16 bits."""
    rng = np.random.default_rng(97)
    by = rng.integers(1, 2**31, trees * deepest, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 2**32, trees * deepest, dtype=np.uint32)
    out = np.empty((len(sets), trees * deepest), np.uint32)
    with np.errstate(over="ignore"):
        for i, s in enumerate(sets):
            x = (s >> np.uint64(32)).astype(np.uint32)
            least = np.full(trees * deepest, 2**32 - 1, np.uint32)
            for a in range(0, len(x), 256):
                y = (x[a : a + 256, None] ^ add) * by
                y ^= y >> np.uint32(15)
                np.minimum(least, (y * by[::-1]).min(axis=0), out=least)
            out[i] = least
        return (mixed(out.astype(np.uint64)) & np.uint64(0xFFFF)).reshape(len(sets), trees, deepest)


def sequences(found: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each set and tree: a hash of the prefix of the least depth, and the labels after it, the first in the highest bits."""
    key = np.broadcast_to(np.arange(found.shape[1], dtype=np.uint64), found.shape[:2])
    with np.errstate(over="ignore"):
        for k in range(least):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + found[:, :, k])
    rest = np.zeros(found.shape[:2], np.uint64)
    for k in range(least, found.shape[2]):
        rest = rest << np.uint64(16) | found[:, :, k]
    return key, rest


def _signed(size: int, trees: int, deepest: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in slices(texts):
                words, first = word_hashes(texts.slice(a, b - a))
                sets = [shingles(words[first[i] : first[i + 1]], size) for i in range(b - a)]
                full = [i for i, s in enumerate(sets) if len(s)]
                both = sequences(labels([sets[i] for i in full], trees, deepest), least)
                rows: list[list] = [[None] * (b - a), [None] * (b - a)]
                for out, values in zip(rows, both):
                    for k, i in enumerate(full):
                        out[i] = values[k].view(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(batch.num_columns - 1)), *(pa.array(x, pa.list_(pa.int64())) for x in rows)], names=["id", "t1", "t2", "keys", "rest"])

    return run


#: Edges of a task, of tables of edges that are small against the number of partitions.
EDGES = 100_000


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many partitions as that number of rows needs, so that small tables don't make a file for each partition."""
    return df.coalesce(max(1, -(-rows // EDGES)))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) of all ends of ``edges`` (u, v): root is the smallest id that a path of edges reaches.

    Large-star and small-star steps (Kiveris et al., 2014) until they change nothing; a step joins edges with one row of each
    id, so a hub's edges can be split, and never gathers a hub's neighbours.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        if large:
            return both.where("b > a").join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v")
        hops = both.where("b < a").join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("u"), F.col("m").alias("v")), F.struct(F.col("a").alias("u"), F.col("m").alias("v")))).alias("e"))
        return hops.select("e.u", "e.v").where("u <> v").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    edges = saved(edges.where("u <> v").distinct())
    before = mark(edges)
    edges = _few(edges, before[0])
    for _ in range(rounds if before[0] else 0):
        edges = saved(_few(star(star(edges, True), False), before[0]))
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("root")), F.struct(F.col("v").alias("id"), F.col("v").alias("root")))).alias("e")).select("e.id", "e.root").distinct()


def _met(similarity: np.ndarray, depth: int, trees: int) -> np.ndarray:
    """The probability that a pair shares a prefix of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def _linked(threshold: float, depth: int, trees: int):
    """For a group: each class's links into the other block (or its own), of components that were apart, the least class that they lead to, and what they stand for."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        ids, block, apart = (table.column(c).to_numpy() for c in ("id", "block", "was"))
        weight = table.column("n").to_numpy().astype(np.float64)
        lists = table.column("shingles").combine_chunks()
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy()[ends[0] : ends[-1]]
        size = np.diff(ends)
        n = len(ids)
        doc = np.repeat(np.arange(n), size)
        _, at, often = np.unique(values, return_inverse=True, return_counts=True)
        shared = often[at] > 1
        doc, at = doc[shared], at[shared]
        column = np.cumsum(often > 1) - 1
        at = column[at]
        wide, both = int((often > 1).sum()), np.zeros((n, n), np.float32)
        order = np.argsort(at, kind="stable")
        doc, at = doc[order], at[order]
        for a in range(0, wide, 4096):
            lo, hi = np.searchsorted(at, (a, a + 4096))
            x = np.zeros((n, min(4096, wide - a)), np.float32)
            x[doc[lo:hi], at[lo:hi] - a] = 1
            both += x @ x.T
        union = size[:, None] + size[None, :] - both
        near = (both >= threshold * union - 1e-6) & (apart[:, None] != apart[None, :])
        if i != j:
            near &= block[:, None] != block[None, :]
        links = near @ weight
        owed = np.where(near, 1 / _met(np.maximum(both / union, threshold), depth, trees), 0.0).sum(axis=1)
        root = np.arange(n)
        while True:
            least = np.minimum(root, np.where(near, root[None, :], n).min(axis=1, initial=n))
            least = least[least]
            if (least == root).all():
                break
            root = least
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, root, ids)
        return pa.table({"id": pa.array(ids), "peer": pa.array(best[root]), "links": pa.array(links.astype(np.int64)), "found": pa.array(near.sum(axis=1).astype(np.int64)), "owed": pa.array(owed)})

    return run


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """docs with a key of each row: its id (null: the least long) and its text's two hashes."""
    key = F.coalesce(F.col(id).cast("long"), F.lit(-(2**63)))
    return docs.withColumns({"_id": key, "_t1": F.xxhash64(F.col(text).cast("string")), "_t2": F.xxhash64(F.lit(1), F.col(text).cast("string"))})


def _sets(rows: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(id, n, shingles) of classes, from the text of each one's least row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in slices(texts):
                words, first = word_hashes(texts.slice(a, b - a))
                sets = [shingles(words[first[i] : first[i + 1]], size).view(np.int64) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(batch.num_columns - 1)), pa.array(sets, pa.list_(pa.int64()))], names=[*batch.schema.names[:-1], "shingles"])

    texts = rows.join(classes.select(F.col("least").alias("id"), "t1", "t2", "n"), ["id", "t1", "t2"]).dropDuplicates(["id", "t1", "t2"])
    return texts.select(F.col("t1").alias("id"), "n", "text").mapInArrow(run, "id long, n long, shingles array<long>")


def _longest(deepest: int, least: int) -> Column:
    """The longest prefix that a row shares with a neighbour in its sorted trie; null where it is alone."""
    order = W.partitionBy("node").orderBy("rest", "c")
    longest = F.lit(None).cast("int")
    for step in (F.lag("rest").over(order), F.lead("rest").over(order)):
        depth = F.when(step.isNotNull(), F.lit(least))
        for d in range(least + 1, deepest + 1):
            depth = F.when(F.shiftrightunsigned(F.col("rest"), 16 * (deepest - d)) == F.shiftrightunsigned(step, 16 * (deepest - d)), F.lit(d)).otherwise(depth)
        longest = F.greatest(longest, depth)
    return longest


def _round(matched: DataFrame, state: DataFrame, sets: DataFrame, depth: int, deepest: int, least: int, threshold: float, trees: int, block: int) -> tuple[DataFrame, DataFrame] | None:
    """One depth: (id, was, root) of classes whose components grow, and (id, peer, links, found, owed) of the groups that were verified; None if no prefix brings anything new."""
    node = F.col("node") if depth == least else F.xxhash64("node", F.shiftrightunsigned(F.col("rest"), 16 * (deepest - depth)))
    rows = matched.where(F.col("longest") >= depth).select(node.alias("node"), F.col("c").alias("id")).join(state.select("id", "comp", "open"), "id")
    there = rows.groupBy("node").agg(F.min("comp").alias("m"), F.max("comp").alias("top"), F.max("open").alias("open")).where("m < top and open").select("node", "m")
    rows = saved(rows.join(there, "node").select("node", "id", "comp", "m"))
    if rows.isEmpty():
        return None
    grown = components(rows.where("comp <> m").select(F.col("comp").alias("u"), F.col("m").alias("v"))).withColumnRenamed("id", "comp")
    members = state.select("id", "comp").join(grown, "comp")
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    members = members.join(sizes, "root").select("id", F.col("comp").alias("was"), "root", "blocks", F.pmod(F.xxhash64("id"), "blocks").alias("block"))
    members = saved(members)
    # any two classes of a component are compared once: later depths pass over pairs inside a component, so none may be left out here
    dealt = members.withColumn("others", F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    groups = sets.join(dealt, "id").withColumn("other", F.explode("others"))
    groups = groups.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "was", "block", "n", "shingles")
    links = groups.groupBy("root", "i", "j").applyInArrow(_linked(threshold, depth, trees), "id long, peer long, links long, found long, owed double")
    return members.select("id", "root"), saved(links.where("found > 0"))


def _classes(docs: DataFrame, id: str, text: str, size: int, threshold: float, trees: int, deepest: int, step: int, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Each row's (id, t1, t2), and for each class of copies: its group's head, the links of a row, whether it leads its group and its least id."""
    small_batches(docs.sparkSession)
    least = forest_depth(trees, deepest, threshold, recall)
    deepest = min(deepest, least + 4)  # the labels after the least depth go into one long
    rows = _keyed(docs.select(F.col(id).alias("doc"), F.col(text).cast("string").alias("text")), "doc", "text")
    rows = rows.select(F.col("_id").alias("id"), F.col("_t1").alias("t1"), F.col("_t2").alias("t2"), "text")
    signed = saved(rows.mapInArrow(_signed(size, trees, deepest, least), "id long, t1 long, t2 long, keys array<long>, rest array<long>"))
    classes = saved(signed.groupBy("t1", "t2").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("keys").alias("keys"), F.first("rest").alias("rest")))
    tries = classes.where("keys is not null").select(F.col("t1").alias("c"), F.explode(F.arrays_zip("keys", "rest")).alias("s")).select("c", F.col("s.keys").alias("node"), F.col("s.rest").alias("rest"))
    matched = saved(tries.withColumn("longest", _longest(deepest, least)).where("longest is not null"))
    state = saved(matched.select(F.col("c").alias("id")).distinct().withColumns({"comp": F.col("id"), "open": F.lit(True), "found": F.lit(0).cast("long"), "owed": F.lit(0.0)}))
    sets = saved(_sets(rows, classes.join(state.select(F.col("id").alias("t1")), "t1", "left_semi"), size))
    verified: list[DataFrame] = []
    for depth in [*range(deepest, least, -step), least]:
        done = _round(matched, state, sets, depth, deepest, least, threshold, trees, block)
        if done:
            grown, links = done
            verified.append(links)
            sums = links.groupBy("id").agg(F.sum("found").alias("f"), F.sum("owed").alias("o"))
            state = state.join(grown, "id", "left").join(sums, "id", "left")
            state = state.select("id", F.coalesce("root", "comp").alias("comp"), (F.col("found") + F.coalesce("f", F.lit(0))).alias("found"), (F.col("owed") + F.coalesce("o", F.lit(0.0))).alias("owed"))
            measured = (F.col("found") + float(_met(np.float64(threshold), depth, trees))) / (F.col("owed") + 1)
            state = saved(state.withColumn("open", measured < recall))
    links = verified[0] if verified else None
    for more in verified[1:]:
        links = links.union(more)
    if links is None:
        group = classes.select("t1", "t2", "least", "n", F.col("t1").alias("root"), F.lit(0).cast("long").alias("links"))
    else:
        found = components(links.select(F.col("id").alias("u"), F.col("peer").alias("v"))).join(links.groupBy("id").agg(F.sum("links").alias("links")), "id")
        group = classes.select("t1", "t2", "least", "n").join(found.withColumnRenamed("id", "t1"), "t1", "left").withColumn("root", F.coalesce("root", "t1"))
    heads = group.groupBy("root").agg(F.min(F.struct("least", "t1", "t2")).alias("head"))
    leads = (F.col("head.t1") == F.col("t1")) & (F.col("head.t2") == F.col("t2"))
    return signed.select("id", "t1", "t2"), group.join(heads, "root").select(
        "t1", "t2", "least", F.col("head.least").alias("head"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), leads.alias("leads")
    )


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8, trees: int = 32, deepest: int = 10, step: int = 4, recall: float = 0.9999, block: int = 512
) -> DataFrame:
    """One row of each row of ``docs``: its id, class_id (the least id of its near-duplicate class) and n_links (rows linked with it, copies too).

    A null id counts as the least long inside, and shows as null. An empty table gives an empty result.
    """
    rows, found = _classes(docs, id, text, size, threshold, trees, deepest, step, recall, block)
    none = lambda c: F.when(F.col(c) != -(2**63), F.col(c))
    return rows.join(found, ["t1", "t2"]).select(none("id").alias(id), none("head").alias("class_id"), F.col("links").alias("n_links"))


def first_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8, trees: int = 32, deepest: int = 10, step: int = 4, recall: float = 0.9999, block: int = 512) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of the least id, and any one of rows that share id and text."""
    _, found = _classes(docs, id, text, size, threshold, trees, deepest, step, recall, block)
    heads = found.where("leads").select(F.col("least").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"))
    kept = _keyed(docs, id, text).join(heads, ["_id", "_t1", "_t2"], "left_semi")
    return kept.dropDuplicates(["_id", "_t1", "_t2"]).drop("_id", "_t1", "_t2")
