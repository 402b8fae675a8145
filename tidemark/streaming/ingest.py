"""Incremental block ingest: a file stream of node blocks, each micro-batch committed before the stream's own cursor.

The batch's rows and its id go into one commit record, and an id not above the last one in the log adds nothing, so a batch that
runs again after a crash has its effect once. The cursor is never ahead of the data.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..control.commit import Log
from ..control.errors import TidemarkError
from ..operators import archive
from ..sources import pull
from ..sources.chain_rpc import NODE_BLOCK

BLOCKS = "net string, height long, block_hash string, parent_hash string, state_root string, extrinsics_root string, header_blob_hash string, body_blob_hash string"


def commit_batch(log: Log, batch: DataFrame, batch_id: int, net: str, app: str = "ingest") -> bool:
    """Appends a batch's new blocks and its cursor; False if ``app``, whose ids ascend, committed the batch before."""
    last = log.last_batch(app)
    if last is not None and batch_id <= last:
        return False
    rows = archive.block_records(batch, net).drop("extrinsics").where("height is not null")
    rows = archive.first_wins(rows, archive.BLOCK, ["header_blob_hash"], log.read("blocks", BLOCKS)).select(*[f.split()[0] for f in BLOCKS.split(", ")])
    with log.transaction(app=app, batch=batch_id) as tx:
        tx.append("blocks", rows)
        top = rows.agg(F.max("height").alias("height")).where("height is not null").select(F.lit(archive.BLOCK[0]).alias("kind"), F.lit(net).alias("key"), "height")
        tx.append("cursors", top)
    return True


def ingest(spark: SparkSession, source: str, log: Log, checkpoint: str, net: str, max_files: int = 100, available_now: bool = True, interval: str = "10 seconds"):
    """Starts the query. ``available_now`` ends when all files are in; else it polls at ``interval``."""
    stream = spark.readStream.schema(NODE_BLOCK).option("maxFilesPerTrigger", max_files).json(source)
    writer = stream.writeStream.foreachBatch(lambda batch, n: commit_batch(log, batch, n, net, f"ingest {net} {checkpoint}") and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def sync_once(spark: SparkSession, log: Log, options: dict, net: str, max_blocks: int = 1024) -> int:
    """Pulls the heights after the log's cursor, at most ``max_blocks``, and commits them with the new cursor; blocks fetched."""
    top = log.read("cursors", "kind string, key string, height long").where(F.col("key") == net).agg(F.max("height")).first()[0]
    tip = pull.retried(pull.client(options).finalized_height, int(options.get("attempts", 3)))
    heights = archive.sync_range(top, tip, max_blocks)
    if not heights:
        return 0
    spark.dataSource.register(pull.NodeBlocks)
    batch = spark.read.format("node_blocks").options(**options, low=heights.start, high=heights.stop - 1).load()
    commit_batch(log, batch, heights.stop, net, f"sync {net}")
    return len(heights)


def sync_loop(step: Callable[[], int], retry: float = 15.0, idle: float = 10.0, stop: Callable[[], bool] = lambda: False, sleep: Callable[[float], None] = time.sleep) -> None:
    """Runs ``step`` until ``stop()``: at once again after work, after ``idle`` seconds without any, after ``retry`` on an error that may pass."""
    while not stop():
        try:
            wait = 0.0 if step() else idle
        except TidemarkError as fault:
            if not fault.retryable:
                raise
            wait = retry
        if wait and not stop():
            sleep(wait)


def changed_parameters(stream: DataFrame) -> DataFrame:
    """Change-only rows of a stream of ``net, height, value, at``: the state is the last value of each net.

    The state is checkpointed, so a restart doesn't emit the last value again.
    """
    import pandas as pd

    def changes(key, batches, state):
        last = state.get[0] if state.exists else None
        out = []
        for batch in batches:
            for row in batch.sort_values("height").itertuples(index=False):
                if row.value != last:
                    out.append((key[0], row.height, row.value))
                    last = row.value
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["net", "height", "value"])

    return stream.groupBy("net").applyInPandasWithState(changes, "net string, height long, value string", "value string", "append", "NoTimeout")
