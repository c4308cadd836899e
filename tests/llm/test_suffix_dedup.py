"""Repeated byte strings against counts of all strings: the index of a bucket, anchors, and the operator on odd rows and hot passages."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from driftwell.llm import suffix_dedup
from driftwell.llm.suffix_dedup import common_prefixes, remove_repeats, repeated, suffix_order


def often(texts, length):
    count = collections.Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    return [[count[t[k : k + length]] > 1 for k in range(len(t) - length + 1)] for t in texts]


def brute(texts, length):
    """(kept, bytes, removed, spans) of each text."""
    raw = [(t or "").encode() for t in texts]
    out = []
    for text, starts in zip(raw, often(raw, length)):
        gone = bytearray(len(text))
        for k, x in enumerate(starts):
            if x:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(text, gone) if not g)
        out.append((kept, len(text), sum(gone), sum(g and not before for g, before in zip(gone, b"\0" + gone))))
    return out


def related(rng, n, letters, most):
    texts = []
    for _ in range(n):
        fresh = "".join(rng.choices(letters, k=rng.randint(0, most)))
        if texts and rng.random() < 0.5:
            x = rng.choice(texts)
            a = rng.randrange(len(x) + 1)
            fresh = fresh[: len(fresh) // 2] + x[a : a + rng.randint(0, most)] + fresh[len(fresh) // 2 :]
        texts.append(fresh)
    return texts


def test_expansion_equals_counts_and_finds_prefixes_by_value():
    rng = random.Random(1)
    for _ in range(300):
        length, letters = rng.choice([2, 3, 5, 9, 17]), rng.choice(["a", "ab", "abc", "abcdefghij"])
        pieces = [t.encode() for t in related(rng, rng.randint(1, 6), letters, 40)]
        assert [x.tolist() for x in repeated(pieces, length)] == often(pieces, length)
        data = np.frombuffer(b"".join(p + b"\xff" for p in pieces), np.uint8)
        order, whole = suffix_order(data, length), data.tobytes()
        lcp = common_prefixes(data, order, length)
        for i in range(1, len(data)):
            a, b = whole[order[i - 1] :][:length], whole[order[i] :][:length]
            assert a <= b
            if b"\xff" not in b and len(b) == length:
                same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), length))
                assert lcp[i] == (same if same < length else -1)


@pytest.mark.parametrize("most", [16, 64, 10_000])
def test_equal_strings_have_equal_anchors_in_chunks_of_any_size(most):
    rng = random.Random(most)
    for length in (4, 8, 20):
        texts = [t.encode() for t in related(rng, 12, "abcd" if length > 4 else "a", 90)]
        anchors, count = {}, 0
        for data, ends, rows, at in suffix_dedup._chunks(pa.array(texts, pa.binary()), length, most):
            begin = np.append(0, ends[:-1])
            for anchor, first, n, text in zip(*(x.tolist() for x in suffix_dedup._anchored(data, ends, length, max(1, length // 4)))):
                for k in range(first, first + n):
                    own = texts[rows[text]][k - begin[text] + at :][:length]
                    assert own == data[k : k + length].tobytes() and len(own) == length
                    assert anchors.setdefault(own, anchor) == anchor
                    count += 1
        assert count == sum(max(0, len(t) - length + 1) for t in texts)


def filled(rng):
    shared = "".join(rng.choices("abcdefgh ", k=500))
    texts = related(rng, 60, "abcdefgh ", 700)
    texts += ["".join(rng.choices("ijkl", k=rng.randint(0, 300))) + shared[rng.randint(0, 40) :] + "".join(rng.choices("mnop", k=rng.randint(0, 300))) for _ in range(60)]
    return texts + [shared] * 9


ODD = [None, "", "x", "é" * 150, "ü" + "é" * 150, "abc" * 400, "z" * 1500, "z" * 199, "w" * 200, "once " + "".join(chr(0x4E00 + k) for k in range(900)), "\n" * 300, "same text " * 3, "same text " * 3]


@pytest.mark.parametrize("most", [20_000, 5])
def test_operator_equals_brute_force(spark, most):
    texts = filled(random.Random(7)) + ODD
    rows = [(None if k % 11 == 0 else k // 2, t, "mine", k, 1.5) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, id int, n_spans double").repartition(6)
    found = remove_repeats(docs, most=most)
    assert found.columns == ["doc_id", "id", "kept", "n_bytes", "n_removed", "n_spans"]
    got = {r.id: r for r in found.collect()}
    assert len(got) == len(texts)
    for k, want in enumerate(brute(texts, 200)):
        r = got[k]
        assert r.doc_id == rows[k][0] and (r.kept is None) == (texts[k] is None)
        assert (bytes(r.kept or b""), r.n_bytes, r.n_removed, r.n_spans) == want, texts[k] and texts[k][:60]


def test_short_strings_text_ids_and_long_texts(spark):
    rng = random.Random(8)
    texts = related(rng, 50, "abcdefghij", 60) + ["".join(rng.choices("klmnopqrst", k=600_000))]
    docs = spark.createDataFrame([(f"d{k:02}", t) for k, t in enumerate(texts)], "id string, body string")
    got = sorted((r.id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(docs, "body", 12).collect())
    assert got == [(f"d{k:02}", *x) for k, x in enumerate(brute(texts, 12))]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(none).collect() == [] and remove_repeats(none).columns == ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"]
