"""A training corpus in five stages: classify, drop repeated lines, drop near duplicates, decontaminate, pack.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet to the shared folder and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.

In every stage a null text counts as empty, rows that share an id or have none are told apart by their texts, repeated rows go or
stay together (of repeated near duplicates all rows of the smallest id stay), columns beside the id and the text pass
through under any name, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, line_dedup, packing, quality_classifier, simhash
from tidemark.llm.common import discard, table, written


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, rejects go; without labels of both kinds all stay."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three or more documents stay in one; ``n_chars`` follows the text. A null text becomes an empty one."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of the smallest id stays; all empty texts are one group.

    Near duplicates are fingerprints within two bits, and of what stays texts of a similarity of 0.8 in five-word shingles.
    """
    return simhash.drop_near_duplicates(docs, similarity=0.8)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a paraphrase with its answer, go; without a benchmark all stay."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all that is left, packed into sequences of at most 2048 tokens; an empty text is its end id alone."""
    out = packing.pack(docs)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", classify_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: The first stage's model and the fourth's latent space have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if name != STAGES[0][0]:
            discard(before)
    return docs
