"""Ranked lexical search against scores of every document, and the treap against the cells it holds."""

import collections
import math
import random
import re

import numpy as np
import pytest
from driftwell.llm import lexical_search
from driftwell.llm.lexical_search import Best, Treap, descend


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=10):
    cut = [(i, collections.Counter(terms(t))) for i, t in docs if terms(t)]
    count, length = len(cut), sum(sum(c.values()) for _, c in cut)
    df = collections.Counter(x for _, c in cut for x in c)
    out = []
    for item, text in sorted(set(items), key=str):
        found = []
        for i, c in cut:
            m = 10 + 90 * sum(c.values()) * count // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 8 * m)) for x in set(terms(text)) if x in c)
            if score > 0:
                found.append((-score, i is not None, i if i is not None else 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def test_a_treap_finds_each_cell_and_its_maxima():
    rng = np.random.default_rng(1)
    for side in (1, 2, 3, 9, 100):
        cell = np.unique(rng.integers(0, side * side, side * 2))
        row, column, value = cell // side, cell % side, rng.integers(1, 50, len(cell))
        treap = Treap(row, column, value)
        for r in range(side):
            for c in range(side):
                node, level = np.array([0]), 0
                while level < treap.depth and node[0] >= 0:
                    half = treap.depth - 1 - level
                    inside = (row >> (half + 1) == r >> (half + 1)) & (column >> (half + 1) == c >> (half + 1))
                    assert treap.value[node[0]] == value[inside].max()
                    node, level = treap.quarter(node, np.array([r >> half & 1]), np.array([c >> half & 1])), level + 1
                there = (row == r) & (column == c)
                assert (node[0] >= 0) == there.any() and (node[0] < 0 or treap.value[node[0]] == value[there][0])


@pytest.mark.parametrize("width", [1, 8])
def test_descent_over_blocks_equals_sums(width):
    rng = np.random.default_rng(width)
    for _ in range(20):
        rows, columns, k = int(rng.integers(1, 40)), int(rng.integers(1, 90)), int(rng.integers(1, 6))
        item, row = np.nonzero(rng.random((5, rows)) < 0.4)
        weight, best, sums = rng.integers(1, 9, len(item)), Best(5, k), []
        for block in range(3):
            grid = np.where(rng.random((rows, columns)) < 0.15, rng.integers(1, 4, (rows, columns)), 0)
            r, c = np.nonzero(grid)
            if len(r):
                here = np.isin(row, r)
                descend(Treap(r, c, grid[r, c]), item[here], row[here], weight[here], best, block * columns, width)
            scores = np.zeros((5, columns), np.int64)
            np.add.at(scores, item, weight[:, None] * grid[row])
            sums.append(scores)
        sums = np.concatenate(sums, axis=1)
        for i in range(5):
            want = sorted((-s, d) for d, s in enumerate(sums[i].tolist()) if s)[:k]
            mine = best.item == i
            assert list(zip((-best.score[mine]).tolist(), best.doc[mine].tolist())) == want


def corpus(seed, n):
    rng = random.Random(seed)
    return [(k, " ".join(f"t{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.randint(0, 60)))) for k in range(n)]


ODD = [(None, None), (None, "t1 t2 t3"), (1, ""), (2, " .,;"), (3, "T1-t2_T3"), (3, "T1-t2_T3"), (4, "é ÉCOLE t1école"), (5, "t7 " * 40_000), (6, "x" * 50_000), (7, "t1 t2\x00t3\x7ft9")]


@pytest.mark.parametrize("pairs", [500_000, 20])
def test_search_equals_brute_force(spark, monkeypatch, pairs):
    monkeypatch.setattr(lexical_search, "BLOCK", 64)
    docs = corpus(1, 700) + [(d + 10_000, t) for d, t in corpus(1, 60)] + ODD
    items = [(k, t) for k, t in corpus(2, 12)] + [(None, "t1 t9"), (3, "t5 T5 école"), (3, "t5 T5 école"), (50, None), (51, ""), (52, "nowhere")]
    df = spark.createDataFrame([(*r, 1, "z") for r in docs], "doc_id long, text string, score int, item string").repartition(5)
    asked = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, doc_id int")
    found = lexical_search.search(df, asked, pairs=pairs)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items)


def test_text_ids_and_fewer_than_k(spark):
    docs = [(f"d{k:03}", t) for k, t in corpus(4, 80)]
    items = [("a", "t1 t2"), ("b", "t399")]
    found = lexical_search.search(spark.createDataFrame(docs, "name string, body string"), spark.createDataFrame(items, "key string, words string"), 3, "name", "body", "key", "words")
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, 3)


def test_empty_tables(spark):
    some, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(none, items).count() == 0
    assert lexical_search.search(some, items.limit(0)).count() == 0
    assert lexical_search.search(some.withColumn("text", some.text.substr(1, 0)), items).count() == 0
