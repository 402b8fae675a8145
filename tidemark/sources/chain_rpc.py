"""Pull sources for blocks: JSON fixtures of node and indexer answers, and clients with injected fetch functions."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..control.errors import raise_error

NODE_BLOCK = "hash string, header struct<parentHash:string,number:string,stateRoot:string,extrinsicsRoot:string,digest:struct<logs:array<string>>>, extrinsics array<string>"
INDEXER_BLOCK = (
    "hash string, height long, transactions array<struct<hash:string,protocolVersion:int,raw:string>>, "
    "systemParameters struct<dParameter:struct<numPermissionedCandidates:int,numRegisteredCandidates:int>>"
)


def node_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODE_BLOCK).json(path)


def indexer_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEXER_BLOCK).json(path)


class NodeClient:
    """The node's four methods over ``fetch(url, body) -> text``; faults become CONNECTION_ERROR, odd answers VALIDATION_FAILED."""

    def __init__(self, url: str, fetch: Callable[[str, str], str]):
        self.url, self.fetch, self._n = url, fetch, 0

    def call(self, method: str, *params):
        self._n += 1
        try:
            answer = json.loads(self.fetch(self.url, json.dumps({"jsonrpc": "2.0", "id": self._n, "method": method, "params": params})))
        except (OSError, TimeoutError) as fault:
            raise_error("CONNECTION_ERROR", str(fault))
        except ValueError:
            raise_error("VALIDATION_FAILED", "the answer is not JSON")
        if "error" in answer:
            raise_error("CONNECTION_ERROR", str(answer["error"]))
        return answer.get("result")

    def finalized_head(self) -> str:
        return self.call("chain_getFinalizedHead")

    def header(self, block_hash: str) -> dict:
        return self.call("chain_getHeader", block_hash)

    def block_hash(self, height: int) -> str | None:
        return self.call("chain_getBlockHash", height)

    def block(self, block_hash: str) -> dict:
        return self.call("chain_getBlock", block_hash)["block"]

    def finalized_height(self) -> int:
        number = str(self.header(self.finalized_head()).get("number", ""))
        try:
            return int(number, 16)
        except ValueError:
            raise_error("VALIDATION_FAILED", f"malformed block number {number!r}")


class IndexerClient:
    """One GraphQL query per height over the same kind of ``fetch``."""

    QUERY = "query($h:Int!){block(offset:{height:$h}){hash height transactions{hash protocolVersion raw} systemParameters{dParameter{numPermissionedCandidates numRegisteredCandidates}}}}"

    def __init__(self, url: str, fetch: Callable[[str, str], str]):
        self.url, self.fetch = url, fetch

    def block(self, height: int) -> dict:
        try:
            answer = json.loads(self.fetch(self.url, json.dumps({"query": self.QUERY, "variables": {"h": height}})))
        except (OSError, TimeoutError) as fault:
            raise_error("CONNECTION_ERROR", str(fault))
        if answer.get("errors") or not (answer.get("data") or {}).get("block"):
            raise_error("NOT_FOUND", f"no block at {height}")
        return answer["data"]["block"]
