"""Harmonic packing of token sequences.

Piece lengths are partitioned into reciprocal-capacity classes and each class fills bins with a fixed number of pieces,
independently of every other class and document. As documents may be cut, a document's tokens become full sequences
and a remainder that is cut greedily at the largest ``capacity // k`` that fits (``k`` = 2, 3, ...), so that a bin of
class ``k`` takes exactly ``k`` equal pieces and wastes under ``k`` tokens. What is left once it has at most
``capacity // 32`` tokens stays in one piece, in the class of its own length.

Every worker fills bins by itself, holding only the open bin of each class, so token ids are not shuffled. The pieces of
a worker's last open bins (fewer than a constant) are ranked within their class over all workers and fill
bins in the same way; of these, the pieces that don't fill a last bin (again fewer than a constant, whatever the corpus)
are laid end to end and cut at capacity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokenizing import default_vocabulary, encode

SMALL = 32


def cuts(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens, in order; they sum to ``n``."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest > capacity // SMALL:
        k = -(-capacity // rest)
        out.append(capacity // k)
        rest -= capacity // k
    return out + [rest] * (rest > 0)


#: Longest sequence: ids of bins are laid out for it.
MAX_CAPACITY = 1 << 20


def _bin_id(worker: int, bin: int) -> int:
    """Ids of bins that a worker filled: above all others, distinct by worker and count."""
    return 1 << 62 | worker << 38 | bin


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: str | None, end_id: int) -> DataFrame:
    """All pieces with their ids (little-endian unsigned 32-bit) and bin; pieces of bins left open have none, but a rank."""

    def cut(batches):
        path = vocabulary or default_vocabulary()
        worker, filled, open_bins = TaskContext.get().partitionId(), 0, {}

        def batch_of(rows):
            columns = list(zip(*rows, strict=True))
            kinds = [id_arrow, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            id_arrow = batch.schema.field(0).type
            done: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or "", path), np.array([end_id], "<u4"))
                start = 0
                for n in cuts(len(ids), capacity):
                    own = open_bins.setdefault(n, [])
                    own.append((key, start, n, ids[start : start + n].tobytes(), len(ids)))
                    start += n
                    if len(own) == capacity // n:
                        done += [(*row, worker, at, _bin_id(worker, filled), at * n) for at, row in enumerate(open_bins.pop(n))]
                        filled += 1
                if len(done) > 4096:
                    yield batch_of(done)
                    done = []
            if done:
                yield batch_of(done)
        for own in open_bins.values():
            yield batch_of([(*row, worker, at, None, None) for at, row in enumerate(own)])

    names = ["id", "start", "length", "ids", "doc_tokens", "worker", "rank", "sequence_id", "offset"]
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = f"id {id_type}, start long, length long, ids binary, doc_tokens long, worker long, rank long, sequence_id long, offset long"
    return docs.select(id_col, text_col).mapInArrow(cut, fields)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, vocabulary: str | None = None, end_id: int = 1
) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids, doc_tokens, sequence_id, offset``; ``capacity`` is at most 2**20.

    Each id of each document, its end id included, lies in exactly one piece; pieces fill a sequence gapless from
    offset 0. Null or empty text: the end id alone. Rows that share an id (or have none) are packed each by itself.
    An empty table gives no rows. Other columns are not read.
    """
    if not 1 <= capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity {capacity} isn't from 1 to {MAX_CAPACITY}")
    cut = written(pieces(docs, id_col, text_col, capacity, vocabulary, end_id), "pieces")
    own = cut.where("sequence_id is not null").select(F.col("id").alias(id_col), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
    loose = cut.where("sequence_id is null").drop("sequence_id", "offset")
    counts = loose.groupBy("length", "worker").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("length")
    bases = counts.select("length", "worker", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(whole).alias("total"))
    k = F.expr(f"{capacity} DIV length")
    at = loose.join(bases, ["length", "worker"]).withColumn("at", F.col("base") + F.col("rank"))
    full = F.expr(f"at < total - total % ({capacity} DIV length)")
    filled = at.where(full).select(
        F.col("id").alias(id_col), "start", "length", "ids", "doc_tokens",
        (F.col("length") * F.lit(1 << 40) + F.expr(f"at DIV ({capacity} DIV length)")).alias("sequence_id"),
        (F.expr(f"at % ({capacity} DIV length)") * F.col("length")).alias("offset"),
    )
    # under 1 + ... + 32 + 64 * 2048 / 32 pieces, whatever the corpus: one task lays them end to end
    tail = Window.orderBy(F.desc("length"), "at").rowsBetween(Window.unboundedPreceding, -1)
    laid = at.where(~full).withColumn("begin", F.coalesce(F.sum("length").over(tail), F.lit(0)))
    laid = laid.withColumn("bin", F.explode(F.sequence(F.expr(f"begin DIV {capacity}"), F.expr(f"(begin + length - 1) DIV {capacity}"))))
    lo = F.greatest(F.col("begin"), F.col("bin") * capacity)
    hi = F.least(F.col("begin") + F.col("length"), (F.col("bin") + 1) * capacity)
    left = laid.select(
        F.col("id").alias(id_col), (F.col("start") + lo - F.col("begin")).alias("start"), (hi - lo).alias("length"),
        F.substring(F.col("ids"), ((lo - F.col("begin")) * 4 + 1).cast("int"), ((hi - lo) * 4).cast("int")).alias("ids"),
        "doc_tokens", F.col("bin").alias("sequence_id"), (lo - F.col("bin") * capacity).alias("offset"),
    )
    return own.unionByName(filled).unionByName(left)
