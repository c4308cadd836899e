"""Quality rules, line dedup, decontamination, packing and licenses against brute force, and on odd rows."""

import collections
import math
import random
import re
import unicodedata
import zlib

import pytest
from driftwell.llm import decontaminate, licenses, line_dedup, packing, quality_rules
from driftwell.llm.common import line_keys, word_hashes

ODD = [
    (None, None, "x", "y", 1), (1, "", "x", None, None), (2, " \t\n\x0b \n", None, "y", 2), (3, "word", "a", "b", 3), (3, "word", "a", "b", 3), (4, "é " * 30 + "\n" + "# * $ % & | < >", "a", "b", 4),
    (5, "the cat sat on the mat " * 40, "a", "b", 5), (6, "Line one here\nLINE ONE here \n\n  line one HERE", "a", "b", 6), (7, "a b c\r\na b c\r\n" * 10, "a", "b", 7), (8, "w" * 5000, None, None, 8),
    (9, " ".join(f"w{i}" for i in range(3000)), "a", "b", 9), (10, "\n", "a", "b", 10), (11, "tail\n", "a", "b", 11),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS)


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_counts_equal_brute_force(spark, odd):
    rng = random.Random(1)
    rows = [(100 + k, " ".join(rng.choices("abcd", k=rng.randint(0, 40))) + "\n" * rng.randint(0, 2)) for k in range(60)]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))

    def want(t):
        w = words(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = collections.Counter(grams)
        lines = [x for x in (t or "").split("\n") if words(x)]
        covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
        letters, lower, ended = sum(unicodedata.category(c)[0] == "L" for c in t or ""), sum(unicodedata.category(x[0]) == "Ll" for x in w), sum(x.rstrip(" \t\x0b\x0c\r")[-1] in ".!?" for x in lines)
        return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), letters, lower, ended, len(set(w)), len(lines)

    for r in quality_rules.counts(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_letters, r.n_lower, r.n_ended, r.n_distinct, r.n_lines) == want(r.text), r.doc_id


@pytest.mark.parametrize("wrong", [0.05, 0.1, 0.2])
def test_a_rule_that_is_often_wrong_gets_that_accuracy_and_loses_no_clean_text(wrong):
    """Four rules see junk of either kind, three at a time; the fifth sees half of it, and speaks against clean texts at random."""
    rng = random.Random(2)
    truth, patterns = [], collections.Counter()
    for _ in range(20_000):
        bad = rng.random() < 0.15
        quiet = rng.randrange(4)
        p = [(-1 if k != quiet and rng.random() < 0.95 else 1) if bad else (1 if rng.random() < 0.97 else 0) for k in range(4)]
        p.append(-1 if rng.random() < (0.5 if bad else wrong) else 1)
        patterns[tuple(p)] += 1
        truth.append((tuple(p), bad))
    model = quality_rules.fit(sorted(patterns.items()), tuple("abcde"))
    assert model.right["e"][0] == pytest.approx(1 - wrong, abs=0.02)
    assert all(model.odds(p) > 0 for p, bad in truth if not bad)
    assert sum(model.odds(p) < 0 for p, bad in truth if bad) > 0.98 * sum(bad for _, bad in truth)
    assert any(-1 in p and model.odds(p) > 0 for p in patterns)


def test_rules_that_speak_against_all_texts_alike_lose_none():
    """Two of five rules are wrong for this corpus; a few texts break others too."""
    patterns = {(1, 1, 1, -1, -1): 40, (-1, -1, 1, -1, -1): 2, (1, 1, 0, -1, -1): 5}
    model = quality_rules.fit(sorted(patterns.items()), tuple("abcde"))
    assert {p: model.odds(p) > 0 for p in patterns} == {(1, 1, 1, -1, -1): True, (-1, -1, 1, -1, -1): False, (1, 1, 0, -1, -1): True}


def test_label_model_without_texts():
    model = quality_rules.fit([])
    assert model.prior == 0.5 and model.odds((1,) * len(quality_rules.RULES)) == 0


def test_rules_on_odd_and_empty_tables(spark, odd):
    for df in (odd, odd.limit(0)):
        out = quality_rules.judged(df.withColumnsRenamed({"lang": "n_words", "source": "t1"}))
        assert out.where("kept and base_failed").count() == 0
        assert out.count() == df.count()
        assert out.where("text is null and n_words <> 0").count() == 0


def dedup(rows, threshold):
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    docs = [(d, (t or "").split("\n")) for d, t in rows]
    often = collections.Counter(k for _, lines in docs for k in {key(x) for x in lines} if k)
    return sorted(((-1 if d is None else d), len(lines), sum(often[key(x)] >= threshold for x in lines), "\n".join(x for x in lines if often[key(x)] < threshold)) for d, lines in docs)


@pytest.mark.parametrize("batches", [1, 9])
def test_line_dedup_equals_brute_force(spark, batches):
    rng = random.Random(3)
    pool = ["alpha beta", " Alpha Beta\t", "gamma", "", "Δelta", "x " * 50]
    rows = [(k, "\n".join(rng.choice(pool) if rng.random() < 0.3 else f"own {k} {rng.random()}" for _ in range(rng.randint(1, 8)))) for k in range(80)] + [(d, t) for d, t, *_ in ODD]
    df = spark.createDataFrame([(d, t, "z", 1) for d, t in rows], "doc_id long, text string, kept_text string, t1 int")
    done = line_dedup.drop_frequent_lines(df, threshold=4, batches=batches).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_text or "") for r in done)
    assert got == dedup(rows, 4)
    assert all(r.t1 == 1 for r in done)


def test_line_dedup_of_an_empty_table(spark):
    assert line_dedup.drop_frequent_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_are_compacted_and_leave_out_what_is_decided(spark):
    runs = line_dedup.LineRuns(spark, threshold=3, fanout=2, buckets=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(1, 1, 1), (2, k, 1)], "h1 long, h2 long, n long").repartition(2, "h1", "h2"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert [tuple(r) for r in runs.frequent().collect()] == [(1, 1, 3)]  # the fourth and fifth are not counted any more
    with line_dedup.sorted_scans(spark):
        plan = runs._merged(runs.runs())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    runs.drop()
    assert runs.frequent().count() == 0


def test_line_keys_of_slices():
    import pyarrow as pa

    texts = pa.array(["a\n b ", None, "", "\n\n", "B\nc", "tail\n"])
    h1, h2, first = line_keys(texts)
    assert first.tolist() == [0, 2, 3, 4, 7, 9, 11]
    assert (h1[1], h2[1]) == (h1[7], h2[7]) and h2[2] == 0 and h2[10] == 0
    again = line_keys(texts.slice(4, 2))
    assert again[0].tolist() == h1[7:].tolist()
    w, f = word_hashes(pa.array(["One two", None, "  ", "TWO"]))
    assert f.tolist() == [0, 2, 2, 2, 3] and w[1] == w[2]


def windows(t, n=5):
    w = (t or "").lower().split()
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


@pytest.mark.parametrize("block", [-1, 20_000, decontaminate.BROADCAST])
def test_containment_equals_brute_force(spark, block):
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(200)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(5, 40)))) for k in range(20)] + [(50, None), (51, ""), (52, items_text := "One two three"), (53, items_text)]
    docs = []
    for k in range(60):
        body = rng.choices(vocabulary, k=rng.randint(0, 200))
        if k % 3 == 0:
            piece = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randint(0, 2)):
                if piece:
                    piece[rng.randrange(len(piece))] = "zzz"
            body[len(body) // 2 : 0] = piece
        docs.append((k, " ".join(body).upper() if k % 5 == 0 else "\n".join(body)))
    docs += [(d, t) for d, t, *_ in ODD if d is not None]
    df, it = spark.createDataFrame([(*r, "k") for r in docs], "doc_id long, text string, item string"), spark.createDataFrame(items, "item_id long, text string")

    def grams(t, n):
        w = (t or "").lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = set()
    for i, t in items:
        own = windows(t)
        if own:
            n = len(next(iter(own)))
            for d, text in docs:
                c = len(own & grams(text, n)) / len(own)
                if c >= 0.8 - 1e-9:
                    want.add((d, i, round(c, 9)))
    got = {(r.doc_id, r.item_id, round(r.containment, 9)) for r in decontaminate.contained(df, it, broadcast_bytes=block).collect()}
    assert got == want and want
    kept = [r.doc_id for r in decontaminate.without_contaminated(df, it, broadcast_bytes=block).collect()]
    bad = {d for d, *_ in want}
    assert sorted(kept) == sorted(d for d, _ in docs if d not in bad)
    assert decontaminate.without_contaminated(df, it).columns == ["doc_id", "text", "item"]


def test_what_is_broadcast_is_bounded_by_bytes(spark):
    df = spark.createDataFrame([(1, "äb", [1, 2, 3]), (None, None, None)], "row long, item string, shingles array<long>")
    assert decontaminate.held_bytes(df) == 2 * (16 + 8) + 3 + 24 and decontaminate.held_bytes(df.limit(0)) == 0


def test_containment_of_text_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([("x", "a b c d e f g h"), ("x", "a b c d e f g h"), (None, "q a b c d e f g h")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "A b c d e f"), ("i", "A b c d e f"), ("short", "g h"), ("none", "z")], "item_id string, text string")
    got = collections.Counter((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.contained(docs, items).collect())
    assert got == {("x", "i", 2, 2): 4, (None, "i", 2, 2): 2, ("x", "short", 1, 1): 2, (None, "short", 1, 1): 1}
    assert decontaminate.without_contaminated(docs, items).count() == 0


def test_signatures_of_a_partition_have_one_width(spark):
    items = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(n + 4))) for k, n in enumerate([1, 2, 3, 4, 5, 8, 9, 16, 17, 31, 32])], "item_id long, text string")
    for r in decontaminate.signatures(items).collect():
        n = len(r.shingles)
        assert r.top // 2 < n <= r.top and len(r.signature) == min(n, r.top - math.ceil(0.8 * r.top - 1e-9) + 1) and len(r.signature) >= n - math.ceil(0.8 * n - 1e-9) + 1


def test_containment_of_empty_tables(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained(odd, none).count() == 0
    assert decontaminate.without_contaminated(odd, none).count() == odd.count()
    assert decontaminate.contained(odd.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            min(fits, key=lambda b: b[0])[0] -= n
        else:
            bins.append([capacity - n])
    return len(bins), sorted(b[0] for b in bins)


def test_plan_equals_one_piece_at_a_time():
    rng = random.Random(6)
    for trial in range(40):
        capacity = rng.randint(3, 40)
        lengths = [rng.randint(1, capacity) if trial % 2 else min(capacity, int(rng.expovariate(0.2)) + 1) for _ in range(rng.randint(1, 300))]
        plan = packing.best_fit_plan(dict(collections.Counter(lengths)), capacity)
        used, seen = collections.Counter(), collections.defaultdict(set)
        for length, rank, count, first, per, offset in plan:
            for j in range(count):
                b, at = first + j // per, offset + j % per * length
                assert not (set(range(at, at + length)) & seen[b])
                seen[b] |= set(range(at, at + length))
                used[length] += 1
        assert used == collections.Counter(lengths)
        assert all(s == set(range(len(s))) for s in seen.values())
        assert (len(seen), sorted(capacity - len(s) for s in seen.values())) == best_fit(lengths, capacity)


def test_packing_round_trip(spark, odd):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.packed(odd).collect()
    texts = {d: x for d, x, *_ in ODD}
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
        ids = np.array(t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for s in by.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    total = collections.Counter()
    for r in rows:
        total[r.doc_id] += r.length
    assert total[3] == 2 * (len(t.encode("word").ids) + 1)
    assert packing.packed(odd.limit(0)).count() == 0


def test_ids_are_those_of_tokenizers():
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, encode = Tokenizer.from_file(path), packing.encoder(path)
    ids = lambda x: np.frombuffer(encode(x), "<u4").tolist()
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a", "b", " ", " ", "'s", "'S", "\n", "\t", "é", "ß", "漢", "😀", "#", "1", "<|endoftext|>", "\x1c", "\x85", "\xa0", "²", "ŉ", "  ", " \n"]) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    latin = [chr(k) for k in range(0x250)]
    texts += [f"a{x} {x}b {x} 1{x}'s{x}{x}" for x in latin] + ["".join(rng.choices(latin + [" "] * 200, k=40)) for _ in range(2000)]
    texts += ["plain words, and more.\nThe end ", " x", "", "x" * 100_000, "don't  stop", "a\n b", "a\n \nb"]
    assert [ids(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_of_other_vocabularies():
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    for x in ("Some words here", "<|startoftext|> x"):
        assert np.frombuffer(packing.encoder(path)(x), "<u4").tolist() == Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids


def test_packing_keeps_added_tokens_and_long_runs_of_spaces(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", " " * 1_000_000, "<|endoftext|>" * 3, None]
    ids = [np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for x in texts]
    assert ids[0].tolist() == [64, 220, 50256, 275, 2]
    rows = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for k, want in enumerate(ids):
        own = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc == k)
        assert sum(n for _, n, _ in own) == len(want)
        assert all(zlib.crc32(want[a : a + n].tobytes()) == crc for a, n, crc in own)


def test_licenses(spark):
    MIT = "Released under the MIT License.\n" + "some words more " * 9  # a header, not a license file
    rows = [
        (1, MIT, "a/b/one.txt"), (2, "Licensed under CC BY-NC 4.0.", "a/LICENSE"), (3, "nothing", "a/b/c/three.txt"), (4, None, "z/four.txt"), (5, "", None),
        (6, "licensed under the apache license, version 2.0", "LICENSE"), (7, "nothing " * 50, "a/seven.txt"), (1, MIT, "a/b/one.txt"),
    ]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, path string, t string")
    got = {(r.doc_id, r.license, r.origin) for r in licenses.scanned(df).collect()}
    assert got == {
        (1, "MIT", "header"), (2, "CC-BY-NC-4.0", "header"), (3, "CC-BY-NC-4.0", "directory"), (4, "Apache-2.0", "directory"), (5, None, "none"), (6, "Apache-2.0", "header"), (7, "CC-BY-NC-4.0", "directory"),
    }
    assert licenses.scanned(df).count() == len(rows)
    assert licenses.scanned(df.limit(0)).count() == 0


def test_license_scores_equal_brute_force(spark):
    rng = random.Random(7)
    common = [f"c{k}" for k in range(30)]
    texts = [rng.choice(list(licenses.TEMPLATES.values())) if k % 2 else " ".join(rng.choices("the license of mit apache under x y z version".split(), k=rng.randint(1, 9))) for k in range(60)]
    texts = [" ".join([*(w for w in t.split() if rng.random() > 0.2), *rng.choices(common, k=rng.randint(0, 3))]) or "x" for t in texts]
    df = spark.createDataFrame([(k, t, f"d{k}/f") for k, t in enumerate(texts)], "doc_id long, text string, path string")
    often = collections.Counter(w for t in texts for w in set(licenses._terms(t)))
    idf = lambda w: math.log((len(texts) + 1) / (often[w] + 1)) + 1

    def vector(t):
        v = {w: n * idf(w) for w, n in collections.Counter(licenses._terms(t)).items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / size for w, x in v.items()}

    templates = [(k, vector(x)) for k, x in [*licenses.TEMPLATES.items(), *licenses.TEXTS.items()]]
    got = {r.doc_id: (r.license, r.score) for r in licenses.scanned(df).where("origin = 'header'").collect()}
    for k, t in enumerate(texts):
        v = vector(t)
        score, name = max(((round(sum(v.get(w, 0) * x for w, x in u.items()), 9), name) for name, u in templates), key=lambda p: (p[0], [-ord(c) for c in p[1]]))
        assert (k in got) == (score >= 0.6)
        if k in got:
            assert got[k] == (name, pytest.approx(score, abs=1e-6))


def test_whole_licenses_speak_for_their_directories_at_any_size_of_the_corpus(spark):
    for n in (50, 2000):
        rows = [(1, "Copyright (c) 2020 Somebody\n\n" + licenses.TEXTS["MIT"], "lib/LICENSE"), (2, "plain", "lib/src/a.c"), (3, "/*\n" + licenses.TEXTS["Apache-2.0"] + "\n*/\n" + "int x;\n" * 50, "app/b.c")]
        rows += [(10 + k, f"some ordinary words of text {k % 7}", f"other/{k}") for k in range(n)]
        got = {r.doc_id: (r.license, r.origin) for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string, path string")).where("license is not null").collect()}
        assert got == {1: ("MIT", "header"), 2: ("MIT", "directory"), 3: ("Apache-2.0", "header")}


def test_license_files_are_told_apart_whatever_the_corpus(spark):
    """Whole licenses, with a name and without some words, speak for what lies beside and below them; a license that is no template speaks for nothing, and a notice in a file counts as a whole."""
    rng = random.Random(3)
    whole = licenses.whole_licenses()
    for n in (20, 1000):
        rows = []
        for k, (name, text) in enumerate(sorted(whole.items())):
            words = text.split(" ")
            changed = "Copyright 2020 Somebody\n\n" + " ".join(w for w in words if rng.random() > 0.02)
            rows += [(10 * k, changed, f"{name}/LICENSE"), (10 * k + 1, "int a plain file", f"{name}/src/deep/a.py")]
        rows += [(902, "# " + licenses.TEXTS["GPL-2.0"].replace("\n", "\n#\n# ") + "\n\nimport os\n" * 20, "notice/a.py"), (903, "plain", "notice/b.py")]
        rows += [(2000 + k, f"some ordinary words of text {k % 7}", f"other/{k}") for k in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, text string, path string")
        got = {r.doc_id: (r.license, r.origin) for r in licenses.scanned(df).collect()}
        for k, name in enumerate(sorted(whole)):
            assert got[10 * k] == (name, "text") and got[10 * k + 1] == (name, "directory")
        unknown = [k for k, name in enumerate(sorted(whole)) if name in ("BSD-3-Clause", "LGPL-2.1", "MPL-2.0", "CC0-1.0")]
        less = {name: text for k, (name, text) in enumerate(sorted(whole.items())) if k not in unknown}
        without = {r.doc_id: (r.license, r.origin) for r in licenses.scanned(df, texts=licenses.TEXTS, wholes=less).collect()}
        assert all(without[10 * k + 1] == (None, "none") for k in unknown)
        assert got[902] == ("GPL-2.0", "header") and got[903] == (None, "none")
        assert all(got[2000 + k] == (None, "none") for k in range(n))


def test_licenses_of_long_texts_and_ties_of_a_directory(spark):
    long = "word " * 200_000 + "\n" + licenses.TEMPLATES["CC0-1.0"] + "\n" + "word " * 1000
    rows = [
        (1, long, "x/one.txt"), (2, licenses.TEMPLATES["CC-BY-4.0"], "d/b"), (3, licenses.TEMPLATES["CC-BY-4.0"], "d/a"), (4, licenses.TEMPLATES["CC-BY-SA-4.0"], "d/c"), (5, "plain", "d/e/f"), (6, None, "d//g"), (7, "plain", "/"),
    ]
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scanned(spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, path string, score double")).collect()}
    assert got[1] == ("CC0-1.0", "header") and got[5] == ("CC-BY-4.0", "directory") and got[7] == (None, "none")
    assert len(got) == len(rows)


def test_license_scan_of_an_empty_table_and_no_templates(spark, odd):
    df = odd.selectExpr("doc_id", "text", "source as path")
    assert licenses.scanned(df, headers={}, texts={}).where("license is not null").count() == 0
    assert licenses.scanned(df.limit(0)).count() == 0


def test_lines_are_added_up_before_they_are_dealt_out(spark):
    docs = spark.createDataFrame([(k, f"shared\nown {k}\nshared") for k in range(40)] + [(40, None), (41, "")], "doc_id long, text string")
    counts = line_dedup.line_counts(docs.repartition(4), batches=3)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning(h1") :]
    assert "partial_sum" in below and below.count("Exchange hashpartitioning(h1") == 1
    got = counts.collect()
    assert sum(r.n for r in got) == 80 and {r.n for r in got} != {1} and len({(r.h1, r.h2) for r in got}) == 41
    assert len(got) == len({(r.batch, r.h1, r.h2) for r in got}) and {r.batch for r in got} <= {0, 1, 2}
