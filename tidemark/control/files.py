"""Small files in a folder of any file system that Spark reaches, and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .errors import raise_error


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share; a temporary one only in local mode."""
    jsc = spark.sparkContext._jsc.sc()
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and jsc.getCheckpointDir().isDefined():
        return str(jsc.getCheckpointDir().get()).rstrip("/")
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise_error("VALIDATION_FAILED", "set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Of DataFrames made and written meanwhile, shuffle files go as soon as the job is over, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write_once(df: DataFrame, path: str) -> None:
    """``df`` as Parquet in a new folder, packed closely: it is read a few times, and its disk counts."""
    with freed_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)


class Files:
    """Whole small files under ``folder``, through Hadoop's file systems: HDFS, object stores, or a local disk in tests."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self._path, self._read = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.folder = str(self._fs.makeQualified(self._path(folder)).toString()).rstrip("/")
        self._local = "/" + self.folder.removeprefix("file:").lstrip("/") if self.folder.startswith("file:") else None
        self._fs.mkdirs(self._path(self.folder))

    def at(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def names(self, sub: str) -> list[str]:
        """Names in a sub-folder, in order, without staged ones; none if it isn't there."""
        here = self._path(self.at(sub))
        found = [s.getPath().getName() for s in self._fs.listStatus(here)] if self._fs.exists(here) else []
        return sorted(n for n in found if not n.startswith("."))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return self._read.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)

    def create(self, name: str, text: str) -> bool:
        """Puts a whole file where none is; False if there is one. Of two writers one wins, and readers never see a part.

        The text is staged and then shown by a link on a local disk, by a rename elsewhere (which refuses an existing name on HDFS; an
        object store needs a committer or a conditional put for two writers at the same instant).
        """
        staged = f"{os.path.dirname(name)}/.{uuid.uuid4().hex}".lstrip("/")
        out = self._fs.create(self._path(self.at(staged)), True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._local is not None:
                os.link(f"{self._local}/{staged}", f"{self._local}/{name}")
                return True
            return not self.exists(name) and bool(self._fs.rename(self._path(self.at(staged)), self._path(self.at(name))))
        except FileExistsError:
            return False
        finally:
            self.delete(staged)

    def probe(self) -> None:
        """Raises unless a second creation is refused and a file reads back as it was written."""
        name = f"_probe/{uuid.uuid4().hex}"
        first, second = self.create(name, "1"), self.create(name, "2")
        sound = first and not second and self.read(name) == "1"
        self.delete(name)
        if not sound:
            raise_error("DURABILITY_CONTRACT_VIOLATION", f"{self.folder} doesn't refuse a second creation")
