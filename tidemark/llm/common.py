"""Shared plumbing of the training-data operators: inputs, shared storage, Arrow helpers."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..control.files import Files, shared_dir, write_once

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a scale directory.

    Texts can be long: unless the session says otherwise, Arrow batches are kept to 1000 rows, which bounds what a Python worker holds.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    write_once(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables from :func:`written` that nothing reads any more."""
    for df in tables:
        folder, name = df._written.rsplit("/", 1)
        Files(df.sparkSession, folder).delete(name)


def joined(left: DataFrame, right: DataFrame, on: str, weight: str, least: int = 50_000, most: int = 100_000, fits=None) -> DataFrame:
    """Inner join with ``right``, which has one row for each ``on``, never null, and in ``weight`` how many rows of ``left`` have it.

    A key of more than ``least`` rows, and of more than one in ``most`` of all, is broadcast: there can't be ``most`` such keys, and
    their rows stay in the tasks they are in. All others are shuffled, so no task gets more than that of one key. A condition
    ``fits`` on rows of ``right`` bounds the size of what is broadcast.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    if total <= least:
        return left.join(right, on)
    is_hot = F.col(weight) > max(least, total // most)
    is_hot = is_hot if fits is None else F.coalesce(is_hot & fits, F.lit(False))
    hot = right.where(is_hot)
    if not hot.limit(1).count():
        return left.join(right, on)
    cold = left.join(F.broadcast(hot.select(on)), on, "left_anti").join(right.where(~is_hot), on)
    return left.join(F.broadcast(hot), on).unionByName(cold)


def to_all(keys: DataFrame, most: int = 1 << 20) -> DataFrame:
    """``keys``, a written table of ids and hashes, to be broadcast if it has at most ``most`` rows, whatever Spark guesses: what is
    joined with it is texts, and they stay where they are then."""
    return F.broadcast(keys) if keys.count() <= most else keys


def free_name(df: DataFrame, *names: str) -> list[str]:
    """Helper column names that clash with no column of ``df`` (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """``order, label, text`` of at most ``max_rows`` labelled documents, those of the smallest id hashes.

    The ids are chosen among the labels alone and broadcast (``max_rows`` bounds them), so no text is shuffled but the
    sample's own. Of several labels of one id the largest counts, of several texts the smallest; null labels don't count.
    """
    marked = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("long").alias("label")).where("_id is not null")
    chosen = marked.withColumn("order", F.xxhash64(F.col("_id").cast("string"))).orderBy("order", "_id").limit(max_rows)
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    return found.groupBy("_id", "order", "label").agg(F.min("text").alias("text")).select("order", "label", "text")


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null reads as empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64, count=n + 1 + col.offset)[col.offset :] if n else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if n and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20):
    """Row ranges of about ``limit`` bytes; a longer row is a range by itself, whole."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi
