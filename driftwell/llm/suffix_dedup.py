"""Repeated byte strings of a corpus, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every string of ``length`` bytes has one anchor: the least hash of its stretches of ``gram`` bytes, the first of equals. Strings that
are equal have the same anchor, so whatever repeats can be found among the strings of one anchor. A text falls into pieces, each the strings with the
same anchor place, one after the other.

1. A first scan counts anchors; the second gives the pieces of those that occur twice or more, by hashes of anchor and piece.
2. A piece that occurs twice, in one text or two, is repeated as a whole, and no text is needed to know it.
3. Of anchors with several different pieces, each different piece's bytes are fetched once, from one text. Anchors are dealt to buckets of some
   megabytes, and each bucket is indexed: suffixes are sorted as deep as ``length``, which gives the transform, and intervals are
   expanded backwards, breadth first, over a wavelet matrix. The intervals of strings of n + 1 bytes end where common prefixes of neighbouring
   suffixes are n bytes long, so common prefixes come out by increasing value; an interval whose end is known already is not expanded. After
   ``length`` rounds the neighbours with no value are those that share ``length`` bytes or more.
4. An anchor of more than ``most`` different pieces, as at the edge of a passage that very many texts share, takes the same steps with anchors of ``length``
   bytes: its strings are pieces of one string each, and step 2 alone decides about them, by counts that need no one task.
5. Repeated strings are gathered by text, and their bytes are cut out.

Texts are named by 128-bit hashes, so ids may be null, repeated or of any type, and texts that occur twice are repeated as a whole. Rows with the same
text are told apart from rows with another by that hash alone; copies within a task are fetched once. Texts cross the network compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import mixed, saved, slices, small_batches, written

_BYTE = np.random.default_rng(12).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once; small, so that they stay near the processor.
CHUNK_BYTES = 1 << 18
_LOW = np.uint64(0xFFFFFFFF)
#: Ends every piece of a bucket: no UTF-8 text has this byte, and none is larger.
END = 255
SPANS = "array<struct<begin: int, stop: int>>"


# --- anchors and pieces


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse."""
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, x, np.uint64))]) for x in (_BASE, pow(_BASE, -1, 2**64)))


def _chunks(texts: pa.Array, length: int, most: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, ends of texts in them, rows, place of the first byte in its text); a text longer than ``most`` comes in chunks that overlap."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    for a, b in slices(texts, most):
        some = texts.slice(a, b - a)
        at = np.frombuffer(some.buffers()[1], np.int64)[some.offset : some.offset + b - a + 1]
        raw = some.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        if len(data) <= most:
            yield data, at[1:] - at[0], np.arange(a, b), 0
            continue
        for c in range(0, len(data) - length + 1, most):
            part = data[c : c + most + length - 1]
            yield part, np.array([len(part)]), np.array([a]), c


def _anchored(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first byte, strings, text) of each piece of those texts."""
    n, width = len(data), length - gram + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 4
    power, back = _powers(max(n, CHUNK_BYTES + length))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[:n])])
        hashes = mixed((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    # least (hash, place) of each ``width`` neighbours: the end of one block of that many, and the beginning of the next
    key = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    whole = np.concatenate([key, np.full(-len(key) % width, ~np.uint64(0))]).reshape(-1, width)
    after = np.minimum.accumulate(whole[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(whole, axis=1).ravel()
    strings = len(key) - width + 1
    place = (np.minimum(after[:strings], before[width - 1 : width - 1 + strings]) & _LOW).astype(np.int64)
    begin = np.append(0, ends[:-1])
    text = np.repeat(np.arange(len(ends)), ends - begin)[:strings]
    own = np.flatnonzero(np.arange(strings) + length <= ends[text])
    if not len(own):
        return (np.zeros(0, np.int64),) * 4
    new = np.flatnonzero(np.append(True, (place[own[1:]] != place[own[:-1]]) | (own[1:] != own[:-1] + 1)))
    first = own[new]
    return hashes[place[first]].view(np.int64), first, np.diff(np.append(new, len(own))), text[first]


def _digests(data: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    raw = data.tobytes()
    return np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(first.tolist(), stop.tolist())), np.int64)


def _anchors_of(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ends, _, _ in _chunks(batch.column(0), length):
                anchor, n = np.unique(_anchored(data, ends, length, gram)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n, pa.int64())], names=["anchor", "n"])

    return run


def _pieces_of(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = (batch.column(k).to_numpy() for k in (0, 1))
            for data, ends, rows, at in _chunks(batch.column(2), length):
                anchor, first, n, text = _anchored(data, ends, length, gram)
                piece = _digests(data, first, first + n + length - 1)
                row, start = rows[text], first - np.append(0, ends[:-1])[text] + at
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, piece, t1[row], t2[row], start.astype(np.int32), n.astype(np.int32))], names=["anchor", "piece", "t1", "t2", "start", "n"])

    return run


# --- the index of a bucket


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """The places of all suffixes, sorted by their first ``depth`` bytes or more: by eight, then by twice as many as before where they tie."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : n + k]
    order, h = np.argsort(key, kind="stable"), 8
    new = np.append(True, key[order[1:]] != key[order[:-1]])
    rank = np.zeros(n + 1, np.int64)  # of a suffix: where its group begins, from 1; nothing comes before everything
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = group + 1
    while h < depth:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        own = order[tied]
        both = rank[own] * np.int64(n + 1) + rank[np.minimum(own + h, n)]
        sort = np.argsort(both, kind="stable")
        order[tied], both = own[sort], both[sort]
        new[tied] = np.append(True, both[1:] != both[:-1])
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = group + 1
        h *= 2
    return order


class Wavelet:
    """Ranks of all bytes in a string, by a wavelet matrix: a bit of each byte a level, the most significant first."""

    def __init__(self, data: np.ndarray):
        self.ones, self.zeros = [], []
        for bit in range(7, -1, -1):
            bits = (data >> bit) & 1 == 1
            self.ones.append(np.concatenate([np.zeros(1, np.int32), np.cumsum(bits, dtype=np.int32)]))
            data = np.concatenate([data[~bits], data[bits]])
            self.zeros.append(len(data) - int(self.ones[-1][-1]))
        self.first = np.zeros(256, np.int64)  # of each byte in the string sorted by this order, and by value
        for byte in range(256):
            at = 0
            for level in range(8):
                one = int(self.ones[level][at])
                at = self.zeros[level] + one if byte >> (7 - level) & 1 else at - one
            self.first[byte] = at
        size = np.bincount(data, minlength=256)
        self.before = np.cumsum(size) - size

    def extended(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of intervals of suffixes that begin with a string: those of the string with each byte that stands before it somewhere, but not the end of a piece."""
        byte = np.zeros(len(left), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            a, b = ones[left].astype(np.int64), ones[right].astype(np.int64)
            left, right, byte = np.concatenate([left - a, zeros + a]), np.concatenate([right - b, zeros + b]), np.concatenate([2 * byte, 2 * byte + 1])
            some = left < right
            left, right, byte = left[some], right[some], byte[some]
        own = byte != END
        shift = (self.before - self.first)[byte[own]]
        return left[own] + shift, right[own] + shift


def common_prefixes(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """The common prefix of each suffix in ``order`` with the one before it, where that is under ``length`` bytes, else -1; the first has 0.

    It holds for suffixes without ``END`` among their first ``length`` bytes, and of them neighbours of another kind never have -1.
    """
    n = len(data)
    transform = Wavelet(data[order - 1])
    known = np.full(n + 1, -1, np.int32)
    known[0] = known[n] = 0
    left, right = np.array([0]), np.array([n])
    for value in range(length):
        left, right = transform.extended(left, right)
        fresh = known[right] < 0
        left, right = left[fresh], right[fresh]
        if not len(left):
            break
        known[right] = value
    return known[:n]


def repeated(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """Of each piece: which of its strings of ``length`` bytes stand elsewhere in these pieces too."""
    data = np.frombuffer(b"".join(p + b"\xff" for p in pieces), np.uint8)
    order = suffix_order(data, length)
    same = common_prefixes(data, order, length) < 0
    often = np.zeros(len(data), bool)
    often[order[same]] = True
    often[order[:-1][same[1:]]] = True
    sizes = np.array([len(p) for p in pieces])
    at = np.cumsum(sizes + 1) - sizes - 1
    return [often[a : a + max(0, s - length + 1)] for a, s in zip(at.tolist(), sizes.tolist())]


def _spans(often: np.ndarray, length: int) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], often, [False]]).astype(np.int8)))
    return [{"begin": a, "stop": b - 1 + length} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def _expanded(length: int):
    """(anchor, piece, spans) of a bucket's pieces that occur once, with the places of their strings that stand in another piece."""
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())]))

    def run(bucket: pa.Table) -> pa.Table:
        once = bucket.column("count").to_numpy() == 1
        spans = [_spans(x, length) if one else [] for x, one in zip(repeated(bucket.column("bytes").to_pylist(), length), once.tolist())]
        some = pa.array([bool(s) for s in spans])
        return pa.table({"anchor": bucket.column("anchor"), "piece": bucket.column("piece"), "spans": pa.array(spans, kind)}).filter(some)

    return run


# --- texts


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a task once, compressed."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        t1, t2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep = []
        for k, key in enumerate(zip(t1, t2)):
            if key not in seen:
                seen.add(key)
                keep.append(k)
        some = batch.take(pa.array(keep, pa.int64()))
        raw = some.column(2).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([pa.compress(x, "zstd", asbytes=True) for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int64())], names=["t1", "t2", "packed", "size"])


def _fetched(length: int):
    """(anchor, piece, count, bytes) of what is wanted of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for packed, size, wanted in zip(*(batch.column(k).to_pylist() for k in range(3))):
                text = pa.decompress(packed, size, "zstd", asbytes=True)
                rows += [(w["anchor"], w["piece"], w["count"], text[w["start"] : w["start"] + w["n"] + length - 1]) for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["anchor", "piece", "count", "bytes"])

    return run


def _strings(length: int):
    """(anchor, piece, count, place, string) of all strings of pieces, strings by 128-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, piece, count, raw in zip(*(x.to_pylist() for x in batch.columns)):
                found = [hashlib.blake2b(raw[k : k + length], digest_size=16).digest() for k in range(len(raw) - length + 1)]
                m = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([anchor] * m, pa.int64()), pa.array([piece] * m, pa.int64()), pa.array([count] * m, pa.int64()), pa.array(range(m), pa.int32()), pa.array(found, pa.binary())], names=["anchor", "piece", "count", "place", "string"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that stay, with the number of all bytes, of removed ones, and of stretches removed."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("_text")).cast(pa.binary()).to_pylist()
        spans = batch.column(batch.schema.get_field_index("_spans")).to_pylist()
        kept, sizes, gone, runs = [], [], [], []
        for text, own in zip(texts, spans):
            parts, at, removed, n = [], 0, 0, 0
            last = -1
            for a, b in sorted((s["begin"], s["stop"]) for s in own or ()):
                if a > last:
                    parts.append(text[at:a])
                    n, removed, last = n + 1, removed + b - a, b
                elif b > last:
                    removed, last = removed + b - last, b
                at = last
            kept.append(None if text is None else b"".join(parts) + text[at:])
            sizes.append(len(text or b""))
            gone.append(removed)
            runs.append(n)
        rest = [k for k, name in enumerate(batch.schema.names) if name not in ("_text", "_spans")]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, gone, runs))], names=[*(batch.schema.names[k] for k in rest), "kept", "n_bytes", "n_removed", "n_spans"])


def _named(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumns({"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text)})


def repeated_spans(texts: DataFrame, length: int = 200, most: int = 20_000, bucket_bytes: int = 2_000_000) -> DataFrame:
    """(t1, t2, spans) of each text of (t1, t2, text) with strings of ``length`` bytes that start elsewhere too; spans may overlap."""
    gram = max(1, length // 4)
    key, name = ["anchor", "piece"], ["t1", "t2"]
    texts = texts.where(F.octet_length("text") >= length)
    anchors = texts.select("text").mapInArrow(_anchors_of(length, gram), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    pieces = texts.select("t1", "t2", "text").mapInArrow(_pieces_of(length, gram), "anchor long, piece long, t1 long, t2 long, start int, n int")
    live = written(pieces.join(saved(anchors), "anchor", "left_semi"))
    kinds = written(live.groupBy(*key).agg(F.count("*").alias("count"), F.min(F.struct(*name, "start", "n")).alias("at")))
    by_anchor = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    contested = written(kinds.join(by_anchor, "anchor"))
    wanted = contested.groupBy("at.t1", "at.t2").agg(F.collect_list(F.struct("anchor", "piece", F.col("at.start").alias("start"), F.col("at.n").alias("n"), "count")).alias("wanted"))
    packed = texts.select("t1", "t2", "text").mapInArrow(_packed, "t1 long, t2 long, packed binary, size long")
    # several tasks may hold a copy of a text
    fetched = packed.join(saved(wanted), name).select("packed", "size", "wanted").mapInArrow(_fetched(length), "anchor long, piece long, count long, bytes binary")
    fetched = written(fetched.groupBy(*key).agg(F.max("count").alias("count"), F.max("bytes").alias("bytes")))
    hot = saved(contested.where(F.col("kinds") > most).select("anchor").distinct())
    calm = fetched.join(hot, "anchor", "left_anti")
    buckets = max(1, -(-(calm.agg(F.sum(F.length("bytes"))).first()[0] or 0) // bucket_bytes))
    dealt = calm.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    expanded = dealt.groupBy("bucket").applyInArrow(_expanded(length), f"anchor long, piece long, spans {SPANS}")
    strings = fetched.join(hot, "anchor", "left_semi").mapInArrow(_strings(length), "anchor long, piece long, count long, place int, string binary")
    often = strings.groupBy("string").agg(F.sum("count").alias("n"), F.min(F.struct(*key, "place")).alias("one")).where("n > 1").select("string")
    span = F.struct(F.col("place").alias("begin"), (F.col("place") + length).alias("stop"))
    counted = strings.where("count = 1").join(often, "string", "left_semi").groupBy(*key).agg(F.collect_list(span).alias("spans"))
    all_of = F.array(F.struct(F.lit(0).alias("begin"), (F.col("at.n") + (length - 1)).alias("stop")))
    marks = saved(kinds.where("count > 1").select(*key, all_of.alias("spans")).union(expanded).union(counted))
    moved = F.transform("spans", lambda s: F.struct((s["begin"] + F.col("start")).alias("begin"), (s["stop"] + F.col("start")).alias("stop")))
    found = live.join(marks, key).select(*name, F.explode(moved).alias("span"))
    return saved(found.groupBy(*name).agg(F.collect_set("span").alias("spans")))


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 200, most: int = 20_000) -> DataFrame:
    """``docs`` with kept instead of the text: its UTF-8 bytes without those covered by a string of ``length`` bytes that starts
    anywhere else too, in the same text or another; and n_bytes before, n_removed and n_spans, the stretches removed.

    Strings are judged on the texts as given; those that overlap count. Columns of ``docs`` keep their names and order; one that is called like a
    new one gives way to the new one. Null texts stay null, with 0 bytes.
    """
    if length < 2:
        raise ValueError("length is at least 2")
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("kept", "n_bytes", "n_removed", "n_spans", text)]
    keyed = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)), F.col(f"`{text}`").cast("string").alias("_text"))
    spans = repeated_spans(_named(keyed.select(F.col("_text").alias("text")), "text"), length, most).select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("spans").alias("_spans"))
    keyed = keyed.withColumns({"_t1": F.xxhash64("_text"), "_t2": F.xxhash64(F.lit(1), "_text")})
    joined = keyed.join(spans, ["_t1", "_t2"], "left").select(*(f"c{k}" for k in range(len(names))), "_text", "_spans")
    kinds = dict(keyed.dtypes)
    done = joined.mapInArrow(_cut, ", ".join([*(f"c{k} {kinds[f'c{k}']}" for k in range(len(names))), "kept binary, n_bytes long, n_removed long, n_spans long"]))
    return done.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)), "kept", "n_bytes", "n_removed", "n_spans")
