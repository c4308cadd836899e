"""Best-fit decreasing packing of token sequences, exact at any number of documents.

Pieces have lengths from 1 to the capacity, and best-fit decreasing looks at lengths only. So it runs on the histogram of
lengths, of at most ``capacity`` numbers: for each length, longest first, a segment tree over remaining capacities finds the
tightest bin that still takes it in logarithmic time, and whole ranges of equal bins and equal pieces are placed in one step.
The outcome is a table of placements whose size depends on the capacity alone. Spark then numbers the pieces of each length
and each piece looks up its placement.

Numbering deals the n pieces of a length to groups of about ``group`` or, if that is more, sqrt(n) pieces by hash, numbers within the groups, and adds what
the groups before hold; copies of one document, all of one length, therefore spread over many tasks.

Null text is empty; an empty document is the end token alone. Rows that are repeated are packed as often. Ids are of any type that
a string can be cast to.
"""

from __future__ import annotations

import json
import math
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftwell.llm.common import saved, slices, small_batches


class OpenBins:
    """Bins by remaining capacity: ranges of bin numbers at the leaves of a segment tree that says where there are any."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.any = [False] * (2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def _mark(self, leaf: int) -> None:
        k = leaf + self.size
        self.any[k] = bool(self.ranges[leaf])
        while k > 1:
            k //= 2
            self.any[k] = self.any[2 * k] or self.any[2 * k + 1]

    def push(self, remaining: int, first: int, count: int) -> None:
        if count and remaining:
            self.ranges[remaining].append((first, count))
            self._mark(remaining)

    def pop(self, remaining: int) -> tuple[int, int]:
        found = self.ranges[remaining].pop()
        self._mark(remaining)
        return found

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of ``need`` or more that a bin has."""
        k = need + self.size
        if self.any[k]:
            return need
        while k > 1:
            if k % 2 == 0 and self.any[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.any[2 * k] else 2 * k + 1
                return k - self.size
            k //= 2
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces, first bin, pieces a bin, offset): pieces of a length, by rank, fill those bins in turn.

    The same bins as best-fit decreasing one piece at a time: a piece goes to the tightest bin, which stays the tightest for
    the next piece of that length while it has room for it.
    """
    bins, made, plan = OpenBins(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = bins.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                first, count = made, -(-left // per)
                made += count
            else:
                first, count = bins.pop(room)
                per = room // length
            whole = min(count, left // per)
            offset = capacity - room
            if whole:
                plan.append((length, rank, whole * per, first, per, offset))
                bins.push(room - per * length, first, whole)
                rank, left = rank + whole * per, left - whole * per
            rest = count - whole
            if left and rest:  # fewer than ``per`` pieces are left: one bin takes them
                plan.append((length, rank, left, first + whole, per, offset))
                bins.push(room - left * length, first + whole, 1)
                left, rest = 0, rest - 1
                bins.push(room, first + whole + 1, rest)
            else:
                bins.push(room, first + whole, rest)
    return plan


def _cut(vocabulary: str, end: int, capacity: int):
    last = np.uint32(end).astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                which, rows = [], []
                for i, text in enumerate(texts.slice(a, b - a).to_pylist(), a):
                    tokens = (encode(text) if text else b"") + last
                    n = len(tokens) // 4
                    at = 0
                    for k, stop in enumerate(range(n % capacity or capacity, n + 1, capacity)):
                        which.append(i)
                        rows.append((k, at, stop - at, zlib.crc32(tokens[4 * at : 4 * stop])))
                        at = stop
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64())))], names=["doc", "piece", "start", "length", "ids_crc32"])

    return run


#: Fixed values of byte-level BPE: the pattern that cuts texts before merges, and the bytes that stand for themselves; others are named from 256 on.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Marks that end words, each a part of its own after a letter.
MARKS = frozenset(".,;:?!")
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


class _Kept(dict):
    """A table that makes what it lacks, and starts anew at ``most`` entries."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


_ENCODERS: dict = {}


def encoder(vocabulary: str):
    """A function from a text to its ids by that vocabulary of tokenizers, added tokens included, as little-endian 32-bit numbers; kept for the process.

    A byte-level BPE merges inside the parts that its pattern cuts a text into, so ids of parts, made by the vocabulary's model, are kept by
    part, and those of whole words by word. Texts that hold an added token, letters beyond Latin ones (where libraries' tables of
    letters could differ) or vocabularies of any other make go to the tokenizer as they are.
    """
    if vocabulary not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as file:
            made = json.load(file)
        tokenizer = Tokenizer.from_file(vocabulary)
        cut = made.get("pre_tokenizer") or {}
        plain = made["model"].get("type") == "BPE" and not any(made["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain &= not made.get("normalizer") and not made.get("post_processor") and not made.get("truncation") and not made.get("padding")
        plain &= sys.byteorder == "little" and array("I").itemsize == 4
        plain &= cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
        _ENCODERS[vocabulary] = _by_parts(tokenizer, [t["content"] for t in made.get("added_tokens") or []]) if plain else partial(_whole, tokenizer)
    return _ENCODERS[vocabulary]


def _whole(tokenizer, text: str) -> bytes:
    return np.asarray(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()


def _by_parts(tokenizer, added: list[str]):
    import regex

    cut, model = regex.compile(BYTE_LEVEL), tokenizer.model
    names = {b: chr(b) for b in PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(PRINTED)))}
    space = names[32]

    def merged(x: str) -> bytes:
        name = space + x[1:] if x[0] == " " and x.isascii() and x[1:].isalpha() else x.encode().decode("latin1").translate(names)
        return array("I", [t.id for t in model.tokenize(name)]).tobytes()

    def of_word(x: str) -> bytes:
        if x.isalpha():  # one part
            return merged(" " + x)
        if x[-1:] in MARKS and x[:-1].isalpha():
            return word[x[:-1]] + part[x[-1]]
        return parts(" " + x)

    part, word = _Kept(merged), _Kept(of_word)
    parts = lambda text: b"".join(map(part.__getitem__, cut.findall(text)))
    whole = re.compile("|".join(["[^\x00-\u024f]", *map(re.escape, added)]))
    # a space that a space or the end follows belongs to a run of white space, which is cut by what stands around it
    runs = re.compile(r" (?:\s|$)")

    def encode(text: str) -> bytes:
        if whole.search(text):
            return _whole(tokenizer, text)
        if runs.search(text):
            return parts(text)
        first, *rest = text.split(" ")
        return parts(first) + b"".join(map(word.__getitem__, rest))

    return encode


def pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = 2, capacity: int = 1024) -> DataFrame:
    """(doc, piece, start, length, ids_crc32): documents longer than the capacity are cut, and the first piece takes the remainder."""
    import public_tokenizers

    small_batches(docs.sparkSession)
    run = _cut(vocabulary or public_tokenizers.path("byte_bpe_50k.json"), end, capacity)
    return docs.select(F.col(id).cast("string").alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc string, piece int, start long, length long, ids_crc32 long").withColumn("doc", F.col("doc").cast(docs.schema[id].dataType))


def packed(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = 2, capacity: int = 1024, group: int = 500) -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset: each sequence holds at most ``capacity`` tokens, without gaps."""
    spark = docs.sparkSession
    cut = saved(pieces(docs, id, text, vocabulary, end, capacity))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    plan = best_fit_plan(histogram, capacity)
    # at most ``capacity`` lengths, and a few placements of each: bounded by the capacity
    lengths = F.broadcast(spark.createDataFrame([(k, -(-n // max(group, math.isqrt(n)))) for k, n in histogram.items()], "length long, groups long"))
    dealt = cut.join(lengths, "length").withColumn("g", F.pmod(F.xxhash64("doc", "piece"), "groups"))
    sizes = dealt.groupBy("length", "g").count()
    before = sizes.select("length", "g", (F.sum("count").over(W.partitionBy("length").orderBy("g")) - F.col("count")).alias("before"))
    ranked = dealt.withColumn("k", F.row_number().over(W.partitionBy("length", "g").orderBy("doc", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "g"]).withColumn("rank", F.col("k") + F.col("before"))
    steps = spark.createDataFrame(plan, "p_length long, p_rank long, p_count long, first long, per long, p_offset long")
    steps = F.broadcast(steps.groupBy("p_length").agg(F.sort_array(F.collect_list(F.struct("p_rank", "p_count", "first", "per", "p_offset"))).alias("steps")))
    step = F.filter("steps", lambda s: (s["p_rank"] <= F.col("rank")) & (F.col("rank") < s["p_rank"] + s["p_count"]))[0]
    placed = ranked.join(steps, ranked["length"] == F.col("p_length")).withColumn("s", step).withColumn("j", F.col("rank") - F.col("s.p_rank"))
    return placed.select(
        F.col("doc").alias(id), "piece", "start", "length", "ids_crc32",
        (F.col("s.first") + F.floor(F.col("j") / F.col("s.per"))).cast("long").alias("sequence_id"),
        (F.col("s.p_offset") + (F.col("j") % F.col("s.per")) * F.col("length")).cast("long").alias("offset"),
    )
