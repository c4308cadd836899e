"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import decontaminate, fixity, jaccard_join, lexical_search, licenses, line_dedup, packing, periodic_runs, quality_classifier, quality_rules, suffix_dedup, suffix_tree, url_filter
from driftwell.llm import pipeline as corpus
from driftwell.llm.common import remainder
from driftwell.llm.sql import ORACLE_SQL
from driftwell.sources.tables import table


#: (verdict, host and path prefix)
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn="crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    return scores.select("doc_id", (remainder("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), columns=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document stands at source/lang/doc_id.txt."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    return licenses.scanned(docs)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op8_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second replica is the first with damage: of 200 pages, by a hash of the id, one is lost, one cut and one changed. What is not there is at -1."""
    pages = table(spark, sf_dir, "pages").select("page_id", fixity.warc_record("page_id", "url", "html").alias("record"))
    kind = F.conv(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 6), 16, 10).cast("long") % 200
    damaged = F.when(kind == 1, F.expr("left(record, length(record) - 9)")).when(kind == 2, F.concat(F.lit("w"), F.expr("substring(record, 2)"))).otherwise(F.col("record"))
    found = fixity.audit(pages, pages.where(kind != 0).select("page_id", damaged.alias("record")))
    return found.fillna(-1, [f"{side}_{c}" for side in ("first", "second") for c in ("offset", "bytes")])


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scored(table(spark, sf_dir, "documents"), held_out=remainder("doc_id") == 1)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the texts repeat themselves, by a hash of the id, before they are searched."""
    docs = periodic_runs.with_planted_run(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs).withColumn("top", periodic_runs.longest())
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_quality_classifier, op2_quality_rules, op3_url_filter, op4_line_dedup, op5_jaccard_join, op6_license_scan,
        op7_best_fit_packing, op8_fixity_audit, op9_suffix_tree, op10_decontamination, op11_periodic_runs, op12_suffix_dedup, op13_lexical_search, pipeline,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
