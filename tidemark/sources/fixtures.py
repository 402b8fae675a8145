"""The driver's tables as event logs, payloads, blocks and commands. Column pruning and filters reach the scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 4096
NET = "net-a"
EPOCH = "1990-01-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ns, scope, key, value, written_at, ord, txid, expected`` of ``events``."""
    e = read(spark, sf_dir, "events")
    value = F.concat(F.round(F.col("value") * 100).cast("long").cast("string"), F.lit(":"), F.col("props"))
    expected = F.when(F.col("event_id") % 4 == 0, None).when(F.col("event_id") % 4 == 1, 0).otherwise(F.col("event_id") % 7)
    return e.select(
        F.lit("events").alias("ns"), F.col("event_type").alias("scope"), F.col("user_id").cast("string").alias("key"), value.alias("value"),
        F.date_trunc("MILLISECOND", "ts").alias("written_at"), F.col("event_id").alias("ord"), (F.col("event_id") / 5).cast("long").alias("txid"), expected.cast("long").alias("expected"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``w, net, doc_id, data`` of ``documents``; sequence numbers are allocated by the checkpoint operators."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("w"), F.col("lang").alias("net"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction-history commands of ``conversations``: three hashes a wallet, one to three identifiers a command."""
    c = read(spark, sf_dir, "conversations")
    n = F.length("text")
    kind = F.when(F.col("turn") % 3 == 2, F.when(F.col("conv_id") % 5 == 0, "rejected").otherwise("finalized")).otherwise("pending")
    ids = F.transform(F.sequence(F.lit(0).cast("long"), n % 3), lambda k: F.concat(F.lit("i"), ((F.col("conv_id") + F.col("turn") + k) % 4).cast("string")))
    return c.select(
        F.col("conv_id").cast("string").alias("wallet_id"), F.col("turn").alias("ord"), kind.alias("kind"), F.concat(F.lit("h"), (F.col("turn") % 3).cast("string")).alias("hash"), ids.alias("identifiers"),
        F.when(F.col("turn") % 2 == 1, n % 10).cast("long").alias("protocol_version"), F.when(F.col("role") == "user", n).cast("decimal(38,0)").alias("fees"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of ``orders``: one height a day, several orders a day are forks."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.lit(NET).alias("net"), F.datediff("o_orderdate", F.lit(EPOCH).cast("date")).cast("long").alias("height"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("block_hash"),
        F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("o_status"), F.col("o_custkey").alias("author"),
    )


def flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order makes its block canonical, F finalises it, P takes no stand."""
    b = blocks(spark, sf_dir)
    return b.select("net", "height", "block_hash", F.when(F.col("o_status") == "F", True).when(F.col("o_status") == "O", False).alias("finalized"), "ord")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of ``lineitem`` in the block of their order; (order, line) collides, as first-write-wins needs."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    b = blocks(spark, sf_dir).select("net", "height", "block_hash", F.col("ord").alias("l_orderkey"))
    return li.join(b, "l_orderkey").select(
        "net", "height", "block_hash", F.sha2(F.col("l_partkey").cast("string"), 256).alias("tx_hash"), F.col("l_linenumber").cast("long").alias("position"), "l_partkey", "l_suppkey", "l_shipdate"
    )


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What :func:`transactions` are made of, before any hash: ``height, l_orderkey, l_partkey, position`` and ``ord``, 1, 2, ... in a block."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    b = blocks(spark, sf_dir).select("height", F.col("ord").alias("l_orderkey"))
    order = F.row_number().over(Window.partitionBy("l_orderkey", "height").orderBy("l_partkey", "l_suppkey", "l_shipdate"))
    return li.join(b, "l_orderkey").select("height", "l_orderkey", "l_partkey", F.col("l_linenumber").cast("long").alias("position"), order.cast("long").alias("ord"))


def cursor_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursor sets of ``events``: a JSON height, which now and then falls back."""
    e = read(spark, sf_dir, "events")
    height = F.when(F.col("event_id") % 10 == 3, F.col("event_id") - 500).otherwise(F.col("event_id"))
    return e.select(
        F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("key"), F.concat(F.lit('{"height":'), height.cast("string"), F.lit("}")).alias("value"),
        F.col("ts").alias("updated_at"), F.col("event_id").alias("ord"),
    )
