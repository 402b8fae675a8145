"""Sessions with the settings that this library relies on, and work that can be given up."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import SparkSession

from .errors import raise_error

#: Settings of a session unless the caller gives others.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.network.timeout": "120s",
    "spark.sql.broadcastTimeout": "120",
}


def session(name: str = "tidemark", checkpoint_dir: str | None = None, **settings: str) -> SparkSession:
    """A session with :data:`SETTINGS`; ``settings`` use underscores for dots or whole names in a dict."""
    builder = SparkSession.builder.appName(name)
    given = {k.replace("_", ".") if k.startswith("spark_") else k: v for k, v in settings.items()}
    for key, value in (SETTINGS | given).items():
        builder = builder.config(key, value)
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return builder.getOrCreate()


def abortable(spark: SparkSession, signal: threading.Event, work, poll: float = 0.05):
    """Runs ``work()`` in a job group; once ``signal`` is set its jobs are cancelled. Raises before it starts if it is set already."""
    if signal.is_set():
        raise_error("TRANSACTION_ROLLED_BACK", "aborted before the start")
    group, done = uuid.uuid4().hex, threading.Event()

    def watch() -> None:
        while not done.wait(poll):
            if signal.is_set():
                spark.sparkContext.cancelJobGroup(group)

    spark.sparkContext.setJobGroup(group, "abortable", True)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        return work()
    except Exception as fault:
        if signal.is_set():
            raise_error("TRANSACTION_ROLLED_BACK", f"aborted: {type(fault).__name__}")
        raise
    finally:
        done.set()
        watcher.join()
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            spark.sparkContext.setLocalProperty(key, None)
