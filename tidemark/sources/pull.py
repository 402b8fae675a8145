"""Blocks pulled from a node as a Spark data source, in batch and as a stream that follows the finalised head.

    spark.dataSource.register(NodeBlocks)
    spark.read.format("node_blocks").option("url", ...).option("low", 0).option("high", 99).load()
    spark.readStream.format("node_blocks").option("url", ...).load()

Options: ``url``; ``fetch``, a ``module:function`` of ``(url, body) -> text`` that does the request (HTTP by default); ``low`` and ``high``,
inclusive; ``per_task``, heights a task; ``max_blocks``, heights a micro-batch; ``attempts`` and ``timeout`` of a request.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..control.errors import ERRORS, raise_error
from ..operators.archive import sync_range
from .chain_rpc import NODE_BLOCK, NodeClient


def http(url: str, body: str, timeout: float = 30.0) -> str:
    request = urllib.request.Request(url, body.encode(), {"content-type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read().decode()


def client(options: dict) -> NodeClient:
    timeout = float(options.get("timeout", 30))
    if "fetch" in options:
        module, _, name = options["fetch"].partition(":")
        return NodeClient(options["url"], getattr(importlib.import_module(module), name))
    return NodeClient(options["url"], lambda url, body: http(url, body, timeout))


def retried(work: Callable, attempts: int = 3, wait: float = 1.0):
    """``work()``, tried again on connection errors with growing waits."""
    for left in range(attempts - 1, -1, -1):
        try:
            return work()
        except ERRORS["CONNECTION_ERROR"]:
            if not left:
                raise
            time.sleep(wait)
            wait *= 2


class Heights(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


def split(low: int, high: int, per_task: int) -> list[Heights]:
    return [Heights(a, min(a + per_task - 1, high)) for a in range(low, high + 1, max(1, per_task))]


def fetched(options: dict, part: Heights) -> Iterator[tuple]:
    """Rows of a range; a height without a block is an error, as it is below the finalised head."""
    node, attempts = client(options), int(options.get("attempts", 3))
    for height in range(part.low, part.high + 1):
        block_hash = retried(lambda at=height: node.block_hash(at), attempts)
        if block_hash is None:
            raise_error("NOT_FOUND", f"no block at {height}")
        block = retried(lambda at=block_hash: node.block(at), attempts)
        h = block.get("header") or {}
        digest = ([str(x) if isinstance(x, str) else json.dumps(x) for x in (h.get("digest") or {}).get("logs") or []],)
        yield block_hash, (h.get("parentHash"), h.get("number"), h.get("stateRoot"), h.get("extrinsicsRoot"), digest), list(block.get("extrinsics") or [])


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Heights]:
        high = self.options.get("high")
        high = int(high) if high is not None else retried(client(self.options).finalized_height, int(self.options.get("attempts", 3)))
        return split(int(self.options.get("low", 0)), high, int(self.options.get("per_task", 256)))

    def read(self, part: Heights) -> Iterator[tuple]:
        return fetched(self.options, part)


class BlockStream(DataSourceStreamReader):
    """Offsets are the next height to fetch; a batch has at most ``max_blocks`` of them, up to the finalised head."""

    def __init__(self, options: dict):
        self.options, self.next = options, int(options.get("low", 0))

    def initialOffset(self) -> dict:
        return {"next": int(self.options.get("low", 0))}

    def latestOffset(self) -> dict:
        tip = retried(client(self.options).finalized_height, int(self.options.get("attempts", 3)))
        heights = sync_range(self.next - 1, tip, int(self.options.get("max_blocks", 1024)))
        self.next = max(self.next, heights.stop if len(heights) else self.next)
        return {"next": self.next}

    def partitions(self, start: dict, end: dict) -> list[Heights]:
        self.next = max(self.next, end["next"])
        return split(start["next"], end["next"] - 1, int(self.options.get("per_task", 256)))

    def read(self, part: Heights) -> Iterator[tuple]:
        return fetched(self.options, part)

    def commit(self, end: dict) -> None:
        pass


class NodeBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "node_blocks"

    def schema(self) -> str:
        return NODE_BLOCK

    def reader(self, schema) -> DataSourceReader:
        return BlockReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return BlockStream(dict(self.options))
