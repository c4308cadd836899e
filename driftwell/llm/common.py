"""What several operators share: checkpoints, Arrow batches and hashes of words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.sources.shared import new_folder, saved, shared_folder, written  # noqa: F401

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Texts of an Arrow slice are cut at about so many bytes, which bounds what numpy holds at once.
SLICE_BYTES = 2_000_000

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORDS = (~_IS_SPACE).astype(np.uint8)
#: Runs of ASCII punctuation are words of their own.
MARKS = _WORDS.copy()
MARKS[[k for k in range(33, 127) if not chr(k).isalnum()]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20_240_517).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def bucketed(df: DataFrame, buckets: int, columns: tuple[str, ...], made: list[tuple[str, str]], sort: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written to the shared folder as a table bucketed by ``columns``, so that joins on them move nothing; ``made`` gets the table's name and folder."""
    name, path = f"driftwell_{uuid.uuid4().hex}", new_folder(df.sparkSession, "bucketed")
    writer = df.write.option("path", path).bucketBy(buckets, *columns)
    (writer.sortBy(*sort) if sort else writer).saveAsTable(name)
    made.append((name, path))
    return df.sparkSession.table(name)


def dropped(spark: SparkSession, made: list[tuple[str, str]]) -> None:
    """Takes away tables that nothing reads any more, and their files."""
    for name, path in made:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    made.clear()


def held(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with those columns computed once a row: a filter on them stays above, where Catalyst would else repeat their expressions below."""
    rest = [c for c in df.columns if c not in columns]
    df = df.select(*(F.col(f"`{c}`") for c in rest), F.explode(F.array(F.struct(*columns))).alias("_held"))
    return df.select(*(F.col(f"`{c}`") for c in rest), *(F.col(f"_held.{c}") for c in columns))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keeps Arrow batches of long texts small; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """That setting of the session for what runs inside; then the one before holds again."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of that many rows at most, for what runs inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    return setting(spark, key, str(rows if now <= 0 else min(rows, now)))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total + n > most and i > start:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def word_hashes(texts: pa.Array, lower: bool = True, kinds: np.ndarray = _WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, in order, and for each text the place of its first word (one more entry ends the last).

    A null text has no words. A-Z are lower-cased if ``lower``. ``kinds`` has a number for each byte: 0 parts words, and so
    does a change from one number to another.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    kind = kinds[data]
    space = kind == 0
    begins = ~space
    begins[1:] &= kind[1:] != kind[:-1]
    cut = ends[:-1][(ends[:-1] < len(data)) & (ends[:-1] > 0)]
    begins[cut] = ~space[cut]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, ends)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    runs = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, runs)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(place.max()) + 1, _BASE), dtype=np.uint64)
        value = _RANDOM[_LOWER[data[starts[0] :]] if lower else data[starts[0] :]] * power[place]
        value[space[starts[0] :]] = 0
        return mixed(np.add.reduceat(value, starts - starts[0])), first


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's windows of ``size`` words; a shorter text with words is one window."""
    if not len(words):
        return words
    size = min(size, len(words))
    with np.errstate(over="ignore"):
        total, weight = np.zeros(len(words) - size + 1, np.uint64), np.uint64(1)
        for k in range(size):
            weight = weight * _BASE
            total += words[k : len(words) - size + 1 + k] * weight
    return np.unique(mixed(total))


def line_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128-bit hashes of the keys of all \\n-split lines, as two columns, and each text's first line.

    A line's key is the line without white space at both ends, A-Z lower-cased. The second column of an empty key is 0, and
    nobody else's. A null or empty text has one empty line.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    first = np.searchsorted(breaks, at) + np.arange(n + 1)
    end = np.append(begin[1:], len(data))
    # a line ends at its break, or where its text ends
    stop = np.zeros(len(begin), bool)
    stop[first[1:] - 1] = True
    end = np.where(stop, end, end - 1)
    ink = np.flatnonzero(~_IS_SPACE[data])
    left, right = np.searchsorted(ink, begin), np.searchsorted(ink, end)
    full = right > left
    keys = np.zeros((2, len(begin)), np.uint64)
    if full.any():
        a, b = ink[left[full]], ink[right[full] - 1] + 1
        runs = b - a
        base = np.repeat(a - np.append(0, np.cumsum(runs)[:-1]), runs)
        byte = _LOWER[data[np.arange(len(base)) + base]]
        place = np.arange(len(base)) - np.repeat(np.append(0, np.cumsum(runs)[:-1]), runs)
        starts = np.append(0, np.cumsum(runs)[:-1])
        with np.errstate(over="ignore"):
            for k, by in enumerate((_BASE, _OTHER)):
                power = np.cumprod(np.full(int(runs.max()), by), dtype=np.uint64)
                keys[k, full] = mixed(np.add.reduceat(_RANDOM[byte] * power[place], starts) + np.uint64(k))
        keys[1, full] |= np.uint64(1)
    return keys[0].view(np.int64), keys[1].view(np.int64), first


def remainder(column: str, by: int = 5):
    """crc32 of a column's text, modulo ``by``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by
