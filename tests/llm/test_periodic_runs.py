"""Periodic runs against brute force: the state word by word, the operator on odd rows, and the query with planted repeats."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from driftwell.llm import periodic_runs
from driftwell.llm.periodic_runs import Catchers
from driftwell.llm.queries import op11_periodic_runs


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(w, least=12):
    """Every stretch in which words p apart are equal, of every p."""
    own = {}
    for p in range(1, len(w) // 2 + 1):
        x = 0
        while x + p < len(w):
            a = x
            while x + p < len(w) and w[x] == w[x + p]:
                x += 1
            if x - a >= p and x - a + p >= least:
                own.setdefault((a, x - a + p), p)
            x += 1
    return sorted(((a, n, p) for (a, n), p in own.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {k for a, n, p in runs for k in range(a + p, a + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def some(rng, most=60):
    n = rng.randint(1, most)
    w = [rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(n)]
    if rng.random() < 0.4:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 5)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("step", [1, 7, 25, 10_000])
def test_runs_are_the_same_however_many_words_come_at_a_time(step):
    rng = random.Random(step)
    for _ in range(150):
        least, texts = rng.choice([2, 4, 12]), [some(rng) for _ in range(rng.randint(1, 4))]
        flat = np.array([x for w in texts for x in w], np.uint64)
        begins = np.array([i == 0 for w in texts for i in range(len(w))])
        catchers, at = Catchers(least), 0
        while at < len(flat):
            n = rng.randint(1, step)
            catchers.append(flat[at : at + n], begins[at : at + n])
            at += n
        assert catchers.runs() == {t: r for t, w in enumerate(texts) if (r := brute(w, least))}


def test_each_appended_word_reports_what_it_completes():
    rng = random.Random(3)
    for _ in range(40):
        w, catchers = [rng.randrange(2) for _ in range(50)], Catchers(4)
        for k, x in enumerate(w):
            catchers.append(np.array([x], np.uint64), np.array([k == 0]))
            assert catchers.runs().get(0, []) == brute(w[: k + 1], 4)


def test_a_comparison_goes_on_over_very_many_words():
    catchers, n = Catchers(), 200_000
    for k in range(0, n, 50_000):
        catchers.append(np.arange(k, k + 50_000, dtype=np.uint64) % np.uint64(40_007), np.arange(k, k + 50_000) == 0)
    assert catchers.runs() == {0: [(0, n, 40_007)]}


ODD = [
    (None, None, 1), (1, "", 2), (2, " \t\n\x0b ", 3), (3, "one", 4), (3, "one", 4), (None, "a b " * 9, 5), (4, "é ü\n" * 8 + "z", 6), (5, "x" * 4000, 7), (6, "x " * 30_000, 8), (7, "the cat sat on the mat\r\n" * 40 + "end", 9),
    (8, " ".join(f"w{k}" for k in range(3000)), 10), (9, " ".join(f"w{k % 1500}" for k in range(3000)), 11), (10, "A a A a A a A a A a A a A", 12), (11, "a b c d e f a b c d e f", 13), (12, "a b c d e f a b c d e", 14),
]


def test_odd_texts_and_clashing_columns(spark):
    docs = spark.createDataFrame([(*r, "mine", [1]) for r in ODD], "doc_id long, text string, id long, runs string, n_words array<int>").withColumnRenamed("text", "my text")
    found = periodic_runs.periodic_runs(docs, "my text")
    assert found.columns == ["doc_id", "id", "n_words", "runs", "collapsed"]
    rows = found.collect()
    assert len(rows) == len(ODD)
    text = {r[2]: r[1] for r in ODD}
    for r in rows:
        w = words(text[r.id])
        want = brute(w) if len(w) < 4000 else [(0, len(w), 1)]
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(w), want, collapsed(w, want))
    assert periodic_runs.periodic_runs(docs.limit(0), "my text").count() == 0


def planted(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected(doc_id, text):
    w = planted(doc_id, text)
    runs = brute(w)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha("".join(f"{a},{n},{p}\n" for a, n, p in runs)), sha(collapsed(w, runs)))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, " ".join(f"v{x}" for x in some(rng, 150)) if k % 17 else rng.choice([None, "", " \n"])) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = op11_periodic_runs(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for c, t in found.dtypes if c not in ("runs_sha256", "collapsed_sha256")] == ["bigint"] * 6
    assert sorted(map(tuple, found.collect())) == [expected(*r) for r in rows]
