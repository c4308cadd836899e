"""URL filters: host and path rules, and a naive Bayes classifier over segmented hosts for urls that no rule decides.

1. Host and path are cut from a url by expressions; the longest rule that fits decides.
2. Names in hosts (parts between dots, hyphens and digits) are often words run together. Word counts of all pages' visible
   texts are a unigram model; each distinct name's substrings are joined with it, and Viterbi picks the likeliest split.
   A part of a host name has 63 letters at most, so no substring is longer; a longer name, which no real host has, is split into such words.
3. Urls that rules decide teach a multinomial naive Bayes classifier over host words and path tokens, hashed to ``buckets``
   features. Its table has a fixed size; it judges the rest.

A url that is null or has no "://" has an empty host and path; no rule fits it, and the class prior decides. Null html has no
words. Without any url decided by a rule, the verdict is allow.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import saved, small_batches

#: The letters that a part of a host can have at most; no longer word is looked for in one.
LONGEST = 63


def parts(url: str) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.locate("://", u) > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and decided; rules are (verdict, host and path prefix), the longest that fits wins."""
    host, path = parts(url)
    df = pages.withColumns({"host": host, "path": path})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r)):
        h, slash, p = text.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(slash + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return df.withColumns({"rule": rule, "decided": verdict})


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tags = re.compile(r"<(script|style)\b[^>]*>.*?</\1\s*>|<[^>]*>", re.S | re.I)
    for batch in batches:
        seen: Counter = Counter()
        for html in batch.column(0).to_pylist():
            if html:
                seen.update(re.findall(r"[^\W\d_]+", tags.sub(" ", html).lower()))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])


def unigrams(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n) of the visible texts of all pages."""
    small_batches(pages.sparkSession)
    return pages.select(F.col(html).cast("string").alias("html")).mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def split_name(name: str, known: dict[str, float], unknown: float) -> list[str]:
    """The likeliest split into words: ``known`` has log probabilities; an unknown character costs ``unknown``."""
    best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - LONGEST), end):
            cost = known.get(name[start:end], unknown if end - start == 1 else -math.inf)
            if best[start] + cost > best[end]:
                best[end], back[end] = best[start] + cost, start
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A name's substrings that may be words, by the name's hashes: a name of n letters has LONGEST n of them, a stretch of it at a time."""
    for batch in batches:
        for t1, t2, name in zip(*(batch.column(k).to_pylist() for k in range(3))):
            for a in range(0, len(name), 1000):
                found = list({name[i : i + k] for i in range(a, min(a + 1000, len(name))) for k in range(1, min(LONGEST, len(name) - i) + 1)})
                yield pa.RecordBatch.from_arrays([pa.array([t1] * len(found), pa.int64()), pa.array([t2] * len(found), pa.int64()), pa.array(found, pa.string())], names=["t1", "t2", "word"])


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, words) of each distinct name, by the (word, n) counts; substrings meet the counts in a join, so neither side has to fit anywhere."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] + 1
    names = names.select(F.xxhash64("name").alias("t1"), F.xxhash64(F.lit(1), "name").alias("t2"), "name")
    pieces = names.mapInArrow(_pieces, "t1 long, t2 long, word string").distinct()
    met = pieces.join(words, "word").groupBy("t1", "t2").agg(F.collect_list(F.struct("word", F.log(F.col("n") / total).alias("p"))).alias("known"))
    unknown = math.log(0.01 / total)

    @F.pandas_udf("array<string>")
    def viterbi(name: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([split_name(x, {} if k is None else {w["word"]: w["p"] for w in k}, unknown) for x, k in zip(name, known)])

    return names.join(met, ["t1", "t2"], "left").select("name", viterbi("name", "known").alias("words"))


def _features(buckets: int) -> Column:
    host = F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.concat(F.lit("h "), w))
    steps = F.filter(F.split(F.lower(F.regexp_replace("path", r"\d+", "0")), r"[^\p{L}0]+"), lambda x: x != "")
    return F.transform(F.concat(host, F.transform(steps, lambda w: F.concat(F.lit("p "), w))), lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))


def judged(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", html: str = "html", buckets: int = 2**14) -> DataFrame:
    """``pages`` without html, with host, path, rule, words (of the host), p_block (the method's) and verdict."""
    spark = pages.sparkSession
    df = ruled(pages.drop(html) if html != url else pages, rules, url)
    hosts = df.select("host").distinct()
    named = hosts.select("host", F.posexplode(F.filter(F.split("host", r"[^\p{L}]+"), lambda x: x != "")).alias("k", "name"))
    split = segmented(named.select("name").distinct(), saved(unigrams(pages, html)))
    by_host = named.join(split, "name").groupBy("host").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "words"))), lambda s: s["words"])).alias("words"))
    by_host = saved(by_host)  # so that the join below is of two plain shuffles, and Spark can split a host that very many pages have
    df = df.join(by_host, "host", "left").withColumn("features", _features(buckets))
    taught = df.where("decided is not null")
    block = (F.col("decided") == "block").cast("long")
    table = taught.select(F.explode("features").alias("f"), block.alias("b")).groupBy("f").agg(F.sum("b").alias("block"), F.sum(1 - F.col("b")).alias("allow")).collect()
    prior = taught.agg(F.coalesce(F.sum(block), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    counts = np.full((2, buckets), 0.5)
    for r in table:
        counts[:, r["f"]] += (r["allow"], r["block"])
    weight = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    # a class that no rule taught is never chosen, and allow is the answer where there is none at all
    bias = math.log((prior["b"] + 1e-9) / (prior["n"] - prior["b"] + 1e-9)) if prior["n"] else -math.inf
    table_of = spark.sparkContext.broadcast(weight)

    @F.pandas_udf("double")
    def p_block(features: pd.Series) -> pd.Series:
        w = table_of.value
        return pd.Series([1 / (1 + math.exp(-max(-50.0, min(50.0, bias + float(w[np.asarray(f, int)].sum()))))) for f in features], dtype=float)

    return df.withColumn("p_block", p_block("features")).withColumn("verdict", F.coalesce("decided", F.when(F.col("p_block") > 0.5, "block").otherwise("allow"))).drop("features", "decided")
