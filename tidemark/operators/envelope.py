"""Versioned envelope of three opaque slots: strict JSON in, strict checks out; a version error comes before a shape error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import checkpoint

VERSION = 1
SLOTS = ("shielded", "unshielded", "dust")
FIELDS = ("envelopeVersion", "walletId", "networkId", "subWallets")


def encode(rows: DataFrame) -> DataFrame:
    """``data``: UTF-8 JSON of ``wallet_id, network_id`` and the three slots; null slots are written as null."""
    slots = F.struct(*[F.col(s).alias(s) for s in SLOTS])
    body = F.struct(F.lit(VERSION).alias(FIELDS[0]), F.col("wallet_id").alias(FIELDS[1]), F.col("network_id").alias(FIELDS[2]), slots.alias(FIELDS[3]))
    return rows.withColumn("data", F.encode(F.to_json(body, {"ignoreNullFields": "false"}), "UTF-8"))


def problem_of(text: Column) -> Column:
    """``CORRUPT`` or ``VERSION_UNSUPPORTED`` for JSON texts that don't decode, else null."""
    v = F.try_parse_json(text)
    version = F.try_variant_get(v, "$.envelopeVersion", "string")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    top, sub = F.json_object_keys(text), F.json_object_keys(F.get_json_object(text, "$.subWallets"))
    same = lambda keys, names: F.array_sort(keys) == F.array(*[F.lit(n) for n in sorted(names)])
    ids = F.lit(True)
    for name in ("walletId", "networkId"):
        ids = ids & (kind(f"$.{name}") == "STRING") & (F.length(F.try_variant_get(v, f"$.{name}", "string")) > 0)
    slots = F.lit(True)
    for s in SLOTS:
        slots = slots & F.coalesce(kind(f"$.subWallets.{s}").isin("STRING", "VOID"), F.lit(True))
    shape = F.coalesce(same(top, FIELDS) & same(sub, SLOTS) & ids & slots, F.lit(False))
    return F.when(v.isNull() | top.isNull(), "CORRUPT").when(version.isNotNull() & (version != str(VERSION)), "VERSION_UNSUPPORTED").when(~shape, "CORRUPT")


def decode(rows: DataFrame, data: str = "data") -> DataFrame:
    """Adds ``problem`` and, where null, ``wallet_id, network_id`` and the slots of the bytes in ``data``."""
    text = F.when(F.is_valid_utf8(F.col(data).cast("string")), F.col(data).cast("string"))
    out = rows.withColumn("problem", problem_of(text))
    get = lambda path: F.when(F.col("problem").isNull(), F.get_json_object(text, path))
    return out.withColumns({"wallet_id": get("$.walletId"), "network_id": get("$.networkId"), **{s: get(f"$.subWallets.{s}") for s in SLOTS}})


def _own() -> Column:
    """Whether an envelope's identity is its owner's."""
    return F.coalesce((F.col("w") == F.col("wallet_id")) & (F.col("net") == F.col("network_id")), F.lit(False))


def save(rows: DataFrame, chunk_size: int = checkpoint.DEFAULT_CHUNK) -> DataFrame:
    """Chunks of encoded envelopes (``w, net, seq`` and the fields); the rows of :func:`refused` aren't saved."""
    return checkpoint.split(encode(rows.where(_own())).select("w", "net", "seq", "data"), chunk_size)


def refused(rows: DataFrame) -> DataFrame:
    """Rows that :func:`save` leaves out: their identity isn't their owner's."""
    return rows.where(~_own())


def load(man: DataFrame, junction: DataFrame, pool: DataFrame) -> DataFrame:
    """Decoded envelopes of manifests; one that doesn't load, or of another identity, is ``CORRUPT``."""
    out = decode(checkpoint.reassemble(man, junction, pool).drop("problem"))
    other = F.col("problem").isNull() & ((F.col("wallet_id") != F.col("w")) | (F.col("network_id") != F.col("net")))
    return out.withColumn("problem", F.when(other, "CORRUPT").otherwise(F.col("problem")))
