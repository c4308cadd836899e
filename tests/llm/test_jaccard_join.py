"""The near-duplicate join against all pairs."""

import collections
import os
import random

import numpy as np
import pytest
from driftwell.llm import jaccard_join as jj


def windows(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, threshold=0.8):
    sets = [windows(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][1] == rows[j][1] or (a and b and len(a & b) >= threshold * len(a | b) - 1e-9):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, base = [], [rng.choices(vocabulary, k=120) for _ in range(12)]
    for k in range(260):
        words = list(rng.choice(base)) if k % 3 else rng.choices(vocabulary, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((k * 7 % 1000, " ".join(words)))
    return rows + [(2000, ""), (2001, ""), (2002, "one two"), (2003, "One  two"), (2004, " \n ")]


@pytest.mark.parametrize("block", [8, 512])
def test_equals_all_pairs(spark, block):
    rows = corpus()
    found = jj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    assert sorted(map(tuple, found)) == brute(rows)


@pytest.mark.parametrize("block", [8, 512])
def test_drifting_texts_lose_no_link_whatever_the_block(spark, block):
    words = [f"w{k}" for k in range(400 * 5 + 104)]
    rows = [(k, " ".join(words[5 * k : 5 * k + 104])) for k in range(400)]
    found = jj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    assert sorted(map(tuple, found)) == [(k, 0, sum(0 <= k + d < 400 for d in (-2, -1, 1, 2))) for k in range(400)]


def test_first_of_each(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, t1 string")
    kept = jj.first_of_each(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c, _ in brute(rows)})
    assert kept[0].t1 == "x"


def test_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string"
    assert jj.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert jj.first_of_each(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None), (None, None)], schema)
    found = sorted(map(tuple, jj.near_duplicates(df).collect()), key=str)
    assert [n for _, _, n in found].count(2) == 3 and [n for _, _, n in found].count(1) == 2
    assert jj.first_of_each(df).count() == 2


def test_depth_shortens_until_the_recall_is_met():
    for trees in (8, 32):
        d = jj.forest_depth(trees, 8, 0.8, 0.999)
        assert 1 - (1 - 0.8**d) ** trees >= 0.999 or d == 1
        assert d == 8 or 1 - (1 - 0.8 ** (d + 1)) ** trees < 0.999


def test_sequences_share_prefixes_as_labels_do():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**64, 40, dtype=np.uint64)) for _ in range(3)]
    sets.append(np.unique(np.append(sets[0][:-1], np.uint64(7))))
    found = jj.labels(sets, 8, 10)
    key, rest = jj.sequences(found, 6)
    for i in range(4):
        for j in range(4):
            for t in range(8):
                assert (key[i, t] == key[j, t]) == (found[i, t, :6] == found[j, t, :6]).all()
                for d in range(7, 11):
                    shift = np.uint64(16 * (10 - d))
                    assert (rest[i, t] >> shift == rest[j, t] >> shift) == (found[i, t, 6:d] == found[j, t, 6:d]).all()
    assert 0.5 < (found[0] == found[3]).mean() < 1


def test_a_dense_group_stops_early_and_keeps_its_links(spark):
    """Of 400 near copies each has links enough; their recall is measured and the shorter prefixes are left to the others."""
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    base = rng.choices(words, k=200)
    rows = []
    for k in range(400):
        own = list(base)
        own[rng.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(own)))
    rows += [(500, " ".join(rng.choices(words, k=60))), (501, " ".join(rng.choices(words, k=60)))]
    found = jj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=64).collect()
    assert sorted(map(tuple, found)) == brute(rows)
    m, p = 399, float(jj._met(np.float64(0.8), 10, 32))
    assert (m + p) / (m / jj._met(np.float64(0.93), 10, 32) + 1) >= 0.9999  # so many links of such similarity end a class's search


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_recall_on_the_documents_table(spark):
    """All pairs of different texts at 0.8 or more, found by shared windows, are in one class, and no links are missing."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    texts = {}
    for d, t in rows:
        texts.setdefault(t, []).append(d)
    sets = {t: windows(t) for t in texts}
    by = collections.defaultdict(list)
    for t, s in sets.items():
        for w in s:
            by[w].append(t)
    shared = collections.Counter()
    for ts in by.values():
        for i, a in enumerate(ts):
            for b in ts[:i]:
                shared[(a, b)] += 1
    pairs = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9]
    links = collections.Counter()
    for a, b in pairs:
        links[a] += len(texts[b])
        links[b] += len(texts[a])
    got = {r.doc_id: r for r in jj.near_duplicates(docs).collect()}
    assert pairs
    assert all(got[texts[a][0]].class_id == got[texts[b][0]].class_id for a, b in pairs)
    assert all(got[d].n_links == links[t] + len(ds) - 1 for t, ds in texts.items() for d in ds)


def test_very_long_texts_and_clashing_columns(spark):
    words = [f"w{k}" for k in range(60_000)]
    changed = list(words)
    changed[30_000] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, "w1 " * 60_000), (4, "short text")]
    df = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "doc_id long, text string, node string, id long, open boolean")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jj.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}
    kept = jj.first_of_each(df)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4] and kept.columns == df.columns
