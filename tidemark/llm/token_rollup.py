"""Token counts as delta-maintained rollups.

Token counts per document become signed rows: an insert adds, a delete takes away, a revision does both. A batch of
deltas is summed by source, language and tokenizer version before it is stored, and committed once under its batch id: the
record that shows its folder is created exclusively, so of several writers of a batch one wins and the others change nothing.
Totals are the sums over committed batches; compaction folds them into one folder without changing them.
"""

from __future__ import annotations

import json
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..control.files import Files
from .common import slices, text_buffers
from .tokenizing import default_vocabulary, encode
from .tokens import word_spans

GROUP = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Tokenizer versions (names are part of the stored key).
BPE, WORDS = "byte_bpe_50k", "ascii_words_1"


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``id_col, source, lang, tokenizer, n_tokens``: a row for each document and tokenizer version.

    Counts whole texts; null or empty text has 0 tokens. A null source or language is a group of its own. Repeated rows and rows
    without an id are counted each by itself. An empty table gives no rows. Other columns are not read.
    """

    def count(batches):
        path = vocabulary or default_vocabulary()
        for batch in batches:
            col = batch.column(3)
            bpe = np.fromiter((len(encode(t or "", path)) for t in col.to_pylist()), np.int64, batch.num_rows)
            data, offsets = text_buffers(col)
            words = [np.zeros(0, np.int64)]
            for lo, hi in slices(offsets):
                words.append(np.diff(word_spans(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[2]))
            for name, n in ((BPE, bpe), (WORDS, np.concatenate(words))):
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([name] * batch.num_rows, pa.string()), pa.array(n, pa.int64())], ["id", "source", "lang", "tokenizer", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col("source").cast("string"), F.col("lang").cast("string"), text_col)
    return rows.mapInArrow(count, f"id {kind}, source string, lang string, tokenizer string, n_tokens long").withColumnRenamed("id", id_col)


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(1).cast("long").alias("n_docs"), F.col("n_tokens").cast("long").alias("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).cast("long").alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old counts out, new counts in: documents stay, their tokens change (and their group, if it did)."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Committed batches of summed deltas under one folder of any file system that Spark writes.

    ``commits/<batch>`` names a batch's folder, ``compactions/<n>`` one folder for all batches that it lists.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Files(spark, path)
        self.path = self.files.folder

    @staticmethod
    def _commit(batch_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9._-]{1,128}", batch_id) or batch_id.startswith((".", "_")):
            raise ValueError(f"not a batch id: {batch_id!r}")
        return f"commits/{batch_id}"

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Store a batch's sums; False, and no change, if the batch was committed before. An empty batch counts as one."""
        record = self._commit(batch_id)
        if batch_id in self.batches():
            return False
        folder = f"data/{batch_id}-{uuid.uuid4().hex}"
        self._summed(deltas).write.parquet(self.files.at(folder))
        # whoever creates the record has committed; a folder that no record names is never read
        if self.files.create(record, json.dumps({"folder": folder})):
            return True
        self.files.delete(folder)
        return False

    def _compacted(self) -> dict:
        last = self.files.names("compactions")[-1:]
        return json.loads(self.files.read(f"compactions/{last[0]}")) if last else {"number": 0, "batches": [], "folder": None}

    def _fresh(self, compacted: dict) -> list[str]:
        done = set(compacted["batches"])
        return [n for n in self.files.names("commits") if n not in done]

    def batches(self) -> list[str]:
        compacted = self._compacted()
        return sorted([*compacted["batches"], *self._fresh(compacted)])

    def _folders(self, compacted: dict) -> list[str]:
        fresh = [json.loads(self.files.read(f"commits/{b}"))["folder"] for b in self._fresh(compacted)]
        return fresh + [compacted["folder"]] * (compacted["folder"] is not None)

    def compact(self) -> bool:
        """Fold all committed batches into one folder; False if another compaction got there first. Totals don't change.

        What it replaces stays for readers that hold the older record, until :meth:`vacuum`.
        """
        old = self._compacted()
        fresh, folder, number = self._fresh(old), f"data/compacted-{uuid.uuid4().hex}", old["number"] + 1
        self._sums(self._folders(old)).write.parquet(self.files.at(folder))
        record = {"number": number, "batches": sorted([*old["batches"], *fresh]), "folder": folder}
        if self.files.create(f"compactions/{number:012d}", json.dumps(record)):
            return True
        self.files.delete(folder)
        return False

    def vacuum(self) -> None:
        """Delete what no reader of the latest record needs: earlier compactions, and records and folders of compacted batches."""
        compacted = self._compacted()
        for batch in set(compacted["batches"]) & set(self.files.names("commits")):
            self.files.delete(json.loads(self.files.read(f"commits/{batch}"))["folder"])
            self.files.delete(f"commits/{batch}")
        for name in self.files.names("compactions"):
            if int(name) < compacted["number"]:
                self.files.delete(json.loads(self.files.read(f"compactions/{name}"))["folder"])
                self.files.delete(f"compactions/{name}")

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def _sums(self, folders: list[str]) -> DataFrame:
        paths = [self.files.at(f) for f in folders]
        return self._summed(self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA))

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens`` over all committed batches; groups that came to nothing are left out."""
        return self._sums(self._folders(self._compacted()))
