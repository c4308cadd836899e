"""Classifier, url filter, fixity audit and suffix tree: held-out accuracy, brute force and odd rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from driftwell.llm import fixity, quality_classifier, suffix_tree, url_filter
from driftwell.llm.common import remainder

from tests.llm.test_text_operators import COLUMNS, ODD

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(1)
    good, bad = [f"{c}{v}{d}" for c in "bcdfg" for v in "aeiou" for d in "lmn"], [f"{c}{v}" for c in "zxq" for v in "uoi"]
    rows, labels = [], []
    for k in range(800):
        y = int(rng.random() < 0.7)
        rows.append((k, " ".join(rng.choice(good if rng.random() < (0.8 if y else 0.4) else bad) + ("" if y or rng.random() < 0.6 else "!!") for _ in range(rng.randint(20, 80)))))
        labels.append((k, y))
    docs = spark.createDataFrame(rows + [(None, None), (9000, ""), (9001, " \n")], "doc_id long, text string")
    known = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_classifier.scored(docs, known, "doc_id % 5 <> 0").collect()}
    assert len(got) == 803 and all(0 <= s <= 1 for s in got.values())
    held = [(got[k], y) for k, y in labels if k % 5 == 0]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.9
    loss = -np.mean([math.log(max(s if y else 1 - s, 1e-9)) for s, y in held])
    assert loss < 0.4


def test_classifier_without_labels_or_rows(spark):
    docs = spark.createDataFrame(ODD, COLUMNS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.scored(docs, none, "true").collect()} == {0.5}
    assert quality_classifier.scored(docs.limit(0), none, "true").count() == 0


def reference_rule(host, path):
    fits = [(t, v) for v, t in RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith(t[t.index("/") :])]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_url_rules_and_odd_urls(spark):
    urls = [
        None, "", "no scheme.com/", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "https://example.com/en/", "http://a.example.com/en/z", "http://example.net/es/1", "http://example.net", "ftp://x.net/fr/#a/b",
        "http://example.com?q=/en/", "http://notexample.com/en/1", "a://b://c.com/d", "http://exampleÉ.com/é", "http://com/", "http://" + "x" * 300 + ".org/" + "p" * 3000, "http://example.com/en/", "http://deep.www.example.com/en/",
    ]
    rows = [(k, u, None if k % 2 else "<p>the quick example farm</p>", "w") for k, u in enumerate(urls)] + [(None, urls[5], None, "w")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, words_ string")
    got = url_filter.judged(df, RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        u = r.url or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        rule, verdict = reference_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert url_filter.judged(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.judged(df, []).collect()} == {"allow"}


def test_hosts_are_split_and_learned_from(spark):
    text = "<p>" + "cheap pills spam farm good news daily garden " * 50 + "</p>"
    rows = [(k, f"http://{'cheappills' if k % 2 else 'goodnews'}.{'bad.net' if k % 2 else 'fine.com'}/a{k}", text) for k in range(40)]
    rows += [(100, "http://cheappillsfarm.org/x", None), (101, "http://dailygoodnews.org/x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judged(df, [("block", "bad.net/"), ("allow", "fine.com/")]).collect()}
    assert got[100].words == ["cheap", "pills", "farm", "org"] or got[100].words[:3] == ["cheap", "pills", "farm"]
    assert (got[100].verdict, got[101].verdict) == ("block", "allow")


def test_words_of_any_length_that_a_host_can_have(spark):
    long, longest = "a" * 20 + "bcdefghijklmnopqrstuv", "z" * 31 + "y" * 32
    assert (len(long), len(longest)) == (41, 63)
    html = f"<p>{long} {longest} pills</p>" * 50
    df = spark.createDataFrame([(1, f"http://{long}pills.org/", html), (2, f"http://{longest}.org/", None)], "page_id long, url string, html string")
    got = {r.page_id: r.words for r in url_filter.judged(df, RULES).collect()}
    assert got[1][:2] == [long, "pills"] and got[2][0] == longest


def test_verdicts_equal_a_direct_bayes(spark):
    """Counts of the features' own names take the place of hashed ones, so the table has buckets enough for no two to meet."""
    rules = [("block", "bad.net/"), ("allow", "fine.com/"), ("block", "mixed.org/a/")]
    rng, stems = random.Random(11), ["cheap", "pills", "spam", "farm", "good", "news", "daily", "garden"]
    urls = []
    for k in range(300):
        words = rng.choices(stems[:5], k=2) if k % 2 else rng.choices(stems[3:], k=2)
        home = rng.choice(["bad.net", "mixed.org", "other.com"]) if k % 2 else rng.choice(["fine.com", "mixed.org", "other.com"])
        urls.append(f"http://{''.join(words)}.{home}/{rng.choice(['a', 'b'])}/{rng.choice(stems)}-{k}/x_{rng.randint(0, 99)}?q")
    text = "<p>" + " ".join(stems + ["net", "org", "com", "bad", "fine", "mixed", "other"]) * 50 + "</p>"
    df = spark.createDataFrame([(k, u, text if k < 20 else None) for k, u in enumerate(urls)], "page_id long, url string, html string")
    buckets = 2**20
    got = url_filter.judged(df, rules, buckets=buckets).collect()

    def features(r):
        steps = [x for x in re.split(r"[^a-z0]+", re.sub(r"\d+", "0", r.path).lower()) if x]
        return [f"h {w}" for w in r.words] + [f"p {w}" for w in steps]

    said = lambda r: dict((t, v) for v, t in rules).get(r.rule)
    counts, docs = {"allow": collections.Counter(), "block": collections.Counter()}, collections.Counter()
    for r in got:
        if said(r):
            counts[said(r)].update(features(r))
            docs[said(r)] += 1
    total = {c: sum(n.values()) + 0.5 * buckets for c, n in counts.items()}
    judged = collections.Counter()
    for r in got:
        assert "".join(r.words) == re.sub(r"[^a-z]", "", r.host)
        odds = math.log(docs["block"] / docs["allow"])
        for f in features(r):
            odds += math.log((counts["block"][f] + 0.5) / total["block"]) - math.log((counts["allow"][f] + 0.5) / total["allow"])
        assert r.p_block == pytest.approx(1 / (1 + math.exp(-odds)), rel=1e-6)
        assert r.verdict == (said(r) or ("block" if odds > 0 else "allow"))
        judged[said(r) is None, r.verdict] += 1
    assert min(judged[True, "block"], judged[True, "allow"]) > 20


def test_a_very_long_host_takes_space_in_proportion(spark):
    name = "cheappills" * 5000
    df = spark.createDataFrame([(1, f"http://{name}.org/", "<p>cheap pills</p>" * 50)], "page_id long, url string, html string")
    got = url_filter.judged(df, RULES).first()
    assert got.words[:10_000] == ["cheap", "pills"] * 5000 and "".join(got.words) == name + "org"


def test_viterbi_equals_all_splits():
    rng = random.Random(5)
    known = {w: -rng.random() * 10 for w in ["a", "ab", "b", "abc", "c", "ca", "cab", "bc"]}

    def all_splits(s):
        if not s:
            yield 0.0, []
        for k in range(1, len(s) + 1):
            if s[:k] in known or k == 1:
                for cost, rest in all_splits(s[k:]):
                    yield known.get(s[:k], -20.0) + cost, [s[:k], *rest]

    for _ in range(50):
        s = "".join(rng.choices("abcd", k=rng.randint(0, 9)))
        want = max(all_splits(s), key=lambda x: x[0])[0]
        got = url_filter.split_name(s, known, -20.0)
        assert "".join(got) == s and sum(known.get(w, -20.0) for w in got) == pytest.approx(want)


def test_audit_locates_every_difference(spark):
    rng = random.Random(6)
    pages = [(k * 3, f"http://x/{k}", "é" * rng.randint(0, 50)) for k in range(300)] + [(None, None, None), (6, "again", "twin")]
    first = spark.createDataFrame(pages, "page_id long, url string, html string")
    changed = [(i, u, (h or "") + "!") if i == 30 else (i, u, h) for i, u, h in pages if i not in (60, 897)] + [(4, "new", "new")]
    second = spark.createDataFrame(changed, first.schema)
    record = lambda df: df.select("page_id", fixity.warc_record("page_id", "url", "html").alias("record"))
    a, b = record(first), record(second)
    got = {r.page_id: r for r in fixity.audit(a, b).collect()}
    assert {k: r.kind for k, r in got.items()} == {30: "changed", 60: "missing", 897: "missing", 4: "added"}

    def places(df):
        at, out = 0, {}
        size = collections.Counter()
        for r in df.collect():
            size[r.page_id] += len(r.record.encode())
        for k in sorted(size, key=lambda k: (k is not None, k or 0)):
            out[k] = (at, size[k])
            at += size[k]
        return out

    pa, pb = places(a), places(b)
    for k, r in got.items():
        assert (r.first_offset, r.first_bytes) == pa.get(k, (None, None))
        assert (r.second_offset, r.second_bytes) == pb.get(k, (None, None))
    assert fixity.audit(a, a).count() == 0
    assert fixity.audit(a.limit(0), a.limit(0)).count() == 0
    assert {r.kind for r in fixity.audit(a.limit(0), b).collect()} == {"added"}
    twin = record(spark.createDataFrame([(6, "again", "twin"), *[p for p in pages[::-1] if p[1] != "again"]], first.schema))
    assert fixity.audit(a, twin).count() == 0


def test_audit_of_keys_of_any_range_and_type(spark):
    ends = [-(2**63), -(2**63) + 1, -1, 0, 1, 2**63 - 1]
    rows = [(k, f"r{k}") for k in ends]
    df = lambda rows, kind="long": spark.createDataFrame(rows, f"page_id {kind}, record string")
    got = fixity.audit(df(rows), df([(k, r + "!" if k in (ends[0], ends[-1]) else r) for k, r in rows if k != -1])).collect()
    at, places = 0, {}
    for k, r in rows:
        places[k] = at
        at += len(r)
    assert {(r.page_id, r.kind, r.first_offset) for r in got} == {(ends[0], "changed", 0), (-1, "missing", places[-1]), (ends[-1], "changed", places[ends[-1]])}
    names = [("a", "x"), ("b", None), (None, "y"), ("c", "z")]
    got = fixity.audit(df(names, "string"), df([("a", "x"), ("b", "w"), ("c", "z")], "string")).collect()
    assert {(r.page_id, r.kind) for r in got} == {("b", "changed"), (None, "missing")}
    assert {r.kind for r in fixity.audit(df([(5, "x")]), df([(5, "y")])).collect()} == {"changed"}


def test_warc_files_round_trip(spark, tmp_path):
    pages = [(1, "http://a/", "<p>one</p>\r\n\r\nmore"), (2, None, ""), (None, "http://c/é", "é\n" * 50), (4, "http://d/", "\r\n\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").select("page_id", fixity.warc_record("page_id", "url", "html").alias("record"))
    fixity.write_warc(df.repartition(2), f"{tmp_path}/w")
    got = fixity.read_warc(spark, f"{tmp_path}/w").collect()
    assert sorted(r.record for r in got) == sorted(r.record for r in df.collect())
    assert all(r.valid and r.date == "1970-01-01T00:00:00Z" for r in got)
    assert {(r.record_id, r.url, r.body) for r in got} == {(f"<urn:page:{'' if k is None else k}>", u or "", h) for k, u, h in pages}
    raw = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))
    assert raw.count(b"WARC/1.1\r\n") == 4 and raw.endswith(b"\r\n\r\n")


def held(c="doc_id"):
    return remainder(c) == 1


def corpus(n=300):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for k in range(n):
        body = rng.choices(vocabulary[:80] if k % 2 else vocabulary[80:], k=rng.randint(0, 60))
        rows.append((k, " ".join(body + passage if k % 3 == 0 else body)))
    return rows + [(d, t) for d, t, *_ in ODD]


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["\n"]


def left_out(d):
    return d is None or zlib.crc32(str(d).encode()) % 5 == 1


def brute_tree(rows, least, gain):
    """Scores by a tree of dictionaries over tuples of words, whole contexts counted anew on each level."""
    train = [tokens(t) for d, t in rows if not left_out(d)]
    c = collections.Counter(w for t in train for w in t)
    room = sum(c.values()) + 0.5 * (len(c) + 1)
    kept, discount, deepest = {(): None}, suffix_tree.DISCOUNT, 0

    def p(context, w):
        if not context:
            return (c[w] + 0.5) / room
        below = float(np.float32(p(context[1:], w)))
        n = kept[context]
        total = sum(n.values())
        return max(n[w] - discount, 0) / total + discount * len(n) / total * below

    def before(t, i, k):
        return tuple(["\t", *t][i + 1 - k : i + 1])

    k = 1
    while True:
        found = collections.defaultdict(collections.Counter)
        for t in train:
            for i, w in enumerate(t):
                if i + 1 >= k and before(t, i, k)[1:] in kept:
                    found[before(t, i, k)][w] += 1
        new = {}
        for context, n in found.items():
            total, g = sum(n.values()), math.lgamma
            if total >= least:
                cost = {w: round(-math.log(float(np.float32(p(context[1:], w)))) * suffix_tree.STEPS) / suffix_tree.STEPS for w in n}
                won = sum(g(x - discount) - g(1 - discount) + (x - 1) * cost[w] for w, x in n.items()) + (len(n) - 1) * math.log(discount) + g(len(n)) - g(total)
                if won > gain:
                    new[context] = n
        if not new:
            break
        kept.update(new)
        k += 1
    out = []
    for _, text in rows:
        t, total = tokens(text), 0.0
        for i, w in enumerate(t):
            j = 0
            while j <= i and before(t, i, j + 1) in kept:
                j += 1
            total += math.log10(p(before(t, i, j), w))
        out.append(total)
    return out, k


@pytest.mark.parametrize("size", [3_000, 40_000, 10_000_000])
def test_scores_equal_brute_force_for_any_size_of_blocks(spark, size):
    rows = corpus() + [(400 + k, "one two three four five six seven " * 3) for k in range(30)]
    got = suffix_tree.scored(spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, part string, block int"), held(), block_bytes=size).collect()
    c = collections.Counter(w for d, t in rows if not left_out(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    scores, depth = brute_tree(rows, 3, 2.0)
    assert depth >= 3
    key = lambda r: (str(r[0]), r[2], r[5])
    base = [sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)) for _, t in rows]
    want = sorted(((d, left_out(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, b, s) for (d, t), b, s in zip(rows, base, scores)), key=key)
    found = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    assert [x[:5] for x in found] == [x[:5] for x in want]
    assert [x[5:] for x in found] == [pytest.approx(x[5:], rel=1e-6) for x in want]
    there = [x for x in found if x[1]]
    assert sum(x[6] for x in there) > sum(x[5] for x in there)


def rare_before_common():
    """Each of many words stands twice, before a common one."""
    rng = random.Random(3)
    return [(k, " ".join(f"r{(10 * k + j) % 400} the {rng.choice('abcd')}" for j in range(10))) for k in range(80)]


def only_pairs_tell():
    """After a comes nearly anything; after b comes c, but d after a b, whatever stood before."""
    rng = random.Random(4)
    out = []
    for k in range(120):
        words = []
        for _ in range(60):
            words.append(rng.choice("abcd") if rng.random() < 0.8 else f"x{rng.randrange(200)}")
            if words[-1] == "b":
                words.append("d" if words[-2:-1] == ["a"] else "c")
        out.append((k, " ".join(words)))
    return out


@pytest.mark.parametrize("rows, loose", [(rare_before_common(), False), (only_pairs_tell(), True)], ids=["rare before common", "only pairs tell"])
def test_few_contexts_pass_through_the_driver(spark, monkeypatch, rows, loose):
    split, cut, by_join = suffix_tree._split, suffix_tree._bucketed, suffix_tree._loose
    names, parts, joined = [], [], []
    monkeypatch.setattr(suffix_tree, "_split", lambda *a: names.append(split(*a)[0]) or split(*a))
    monkeypatch.setattr(suffix_tree, "_bucketed", lambda df, n, made: parts.append(n) or cut(df, n, made))
    monkeypatch.setattr(suffix_tree, "_loose", lambda *a: joined.append(1) or by_join(*a))
    got = suffix_tree.scored(spark.createDataFrame(rows, "doc_id long, text string"), held(), block_bytes=900).collect()
    assert max(parts) > 3 and any(len(x) for x in names)
    assert max(len(x) for x in names) < 2 * max(parts)
    assert bool(joined) == loose
    scores, depth = brute_tree(rows, 3, 2.0)
    assert depth >= 2
    assert [r.score for r in sorted(got)] == [pytest.approx(x, rel=1e-6) for x in scores]


def test_probabilities_of_a_context_add_up_to_one():
    rng = np.random.default_rng(2)
    suffix = rng.dirichlet(np.ones(50))
    counts = rng.integers(0, 6, 50).astype(float)
    assert suffix_tree.smoothed(counts, counts.sum(), (counts > 0).sum(), suffix).sum() == pytest.approx(1.0)


def test_ids_of_any_type(spark):
    got = suffix_tree.scored(spark.createDataFrame([("a", "x y"), ("b", None), (None, "x")], "doc_id string, text string"), held())
    assert sorted(str(r.doc_id) for r in got.collect()) == ["None", "a", "b"]


def test_scores_of_an_empty_table(spark):
    assert suffix_tree.scored(spark.createDataFrame([], "doc_id long, text string"), held()).count() == 0
    only = suffix_tree.scored(spark.createDataFrame([(None, "never learned")], "doc_id long, text string"), held()).first()
    assert only.train_tokens == 0 and only.n_known == 0


