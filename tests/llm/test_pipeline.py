"""Each stage of the pipeline on planted documents against brute force, and text operators against their SQL."""

import random

import __spark_entry__
import corpus_pipeline
import duckdb
import numpy as np
import pytest

from tests.llm.test_text_operators import best_fit, dedup, windows
from tests.test_queries import SF, TABLES, plain, pytestmark  # noqa: F401


def test_stages_equal_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(8)
    text = lambda n: " ".join(f"word{rng.randrange(4000)}" for _ in range(n))
    item = text(20)
    docs = {k: f"{text(40)}\n{text(40)}\n{text(rng.choice([40, 700, 2500]))}" for k in range(40)}
    docs |= {40: "too short", 41: "again and again " * 40, 42: docs[3], 43: docs[5] + " end"}
    docs |= {k: docs[k] + "\nA common line" for k in range(10, 22)}
    docs |= {44: f"{text(60)} {item} {text(60)}\n{text(9)}\n{text(9)}"}
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def after(name, d):
        df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in d.items()], "doc_id long, text string, lang string, source string, n_chars long")
        return stages[name](spark, df, str(tmp_path)).collect()

    now = {r.doc_id: r.text for r in after("quality_rules", docs)}
    assert now == {k: t for k, t in docs.items() if k not in (40, 41)}
    rows = after("line_dedup", now)
    assert sorted((r.doc_id, r.text) for r in rows) == [(k, t) for k, _, _, t in dedup(now.items(), 10)] and all(r.n_chars == len(r.text) for r in rows)
    now = {r.doc_id: r.text for r in rows}
    assert now[10] == docs[10].removesuffix("\nA common line")
    kept = {r.doc_id: r.text for r in after("ngram_jaccard_join", now)}
    w = {k: windows(t) for k, t in now.items()}
    assert kept == {k: t for k, t in now.items() if not any(j < k and len(w[j] & w[k]) >= 0.8 * len(w[j] | w[k]) for j in now)} and not {42, 43} & set(kept)
    clean = {r.doc_id: r.text for r in after("benchmark_decontamination", kept)}
    own = windows(item)
    assert clean == {k: t for k, t in kept.items() if len(own & w[k]) < 0.8 * len(own)} and 44 not in clean
    packed = after("best_fit_packing", clean)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = [len(t.encode(x, add_special_tokens=False).ids) + 1 for x in clean.values()]
    pieces = [1024] * sum(n // 1024 for n in sizes) + [n % 1024 for n in sizes if n % 1024]
    assert sorted(r.length for r in packed) == sorted(pieces)
    assert len({r.sequence_id for r in packed}) == best_fit(pieces, 1024)[0]


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("op")))
def test_text_operator_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = plain(__spark_entry__.queries()[name](spark, SF).toPandas()), plain(con.sql(__spark_entry__.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        same = np.allclose(got[c], want[c], rtol=0, atol=2e-6, equal_nan=True) if got[c].dtype == float and want[c].dtype == float else (got[c].astype(str) == want[c].astype(str)).all()
        assert same, c
