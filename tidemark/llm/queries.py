"""Thin queries over the operators: each reads its whole table, applies its operator and derives the asked columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_text, line_dedup, packing, pii, quality_classifier, quality_rules, secret_scan, simhash, token_rollup
from .common import shared_dir, table, written


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["k"] == secret_scan.ORDER[kind])).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secret_scan.spelled(F.col("base")), 256).alias("base_sha256"),
        secret_scan.spelled(F.array_sort(F.concat("base", "weak"))).alias("spans"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after loading all documents, loading them again (no change), deleting the toxic ones and revising the bad ones.

    The revision of a document of quality 0 counts its text without lines that repeat an earlier line.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    counts = written(token_rollup.measured(docs), "token-counts")
    rollup = token_rollup.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("load", token_rollup.inserts(counts))
    rollup.commit("load", token_rollup.inserts(counts))
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    rollup.commit("delete-toxic", token_rollup.deletes(counts.join(toxic, "doc_id", "left_semi")))
    poor = labels.where("quality = 0").select("doc_id").distinct().join(toxic, "doc_id", "left_anti")
    # a text without repeated lines keeps its counts: changed rows alone are counted, as they were and as they are, before ids are joined
    unique_lines = docs.withColumn("unique_text", F.array_join(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n")), "\n")).where("unique_text <> text")
    both = unique_lines.select("doc_id", "source", "lang", F.explode(F.array(F.struct(F.lit(-1).alias("sign"), "text"), F.struct(F.lit(1).alias("sign"), F.col("unique_text").alias("text")))).alias("v"))
    both = both.select(F.struct("doc_id", "v.sign").alias("row"), "source", "lang", "v.text")
    revised = written(token_rollup.measured(both, id_col="row").select("row.*", *token_rollup.GROUP, "n_tokens"), "revised-counts").join(poor, "doc_id", "left_semi")
    rollup.commit("revise-poor", token_rollup.revisions(revised.where("sign < 0"), revised.where("sign > 0")))
    rollup.compact()
    return rollup.totals()


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", F.round("lcs", 4).alias("lcs"), F.round("answer", 4).alias("answer"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, forest).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.classify(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality_classifier.held_out("doc_id").alias("held_out"), "score", "predicted")


#: Key of the query's pseudonyms; a real run passes its own.
PSEUDONYM_KEY = "public-demonstration-key"


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)
    return out.select("doc_id", "text", "n_numbers", "n_dates", "n_emails")


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_token_counts, op3_line_dedup, op4_decontamination, op5_quality_rules, op6_packing, op7_simhash, op8_html_extraction,
        op9_quality_classifier, op10_pii,
    )
}

_KEY = r"""translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""

ORACLES = {
    "op3_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents
        ), keyed AS (SELECT doc_id, n, line, {_KEY} AS k FROM lines),
        repeated AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
        judged AS (SELECT keyed.*, coalesce(keeper <> doc_id, false) AS gone FROM keyed LEFT JOIN repeated USING (k))
        SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
}
