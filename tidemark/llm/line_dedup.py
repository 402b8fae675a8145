"""Line deduplication with two Bloom filters and exact confirmation.

Every map task notes the hashes of the line keys of its documents (each key once per document) in a pair of bit
arrays: seen once, and seen at least twice. Pairs merge by ``twice = t1 | t2 | (o1 & o2)``, segment by segment, so
building them moves at most a few bytes per line and no text. A key whose bits all stand in the twice-seen filter is
*suspected*; a key found in two documents always is. Only suspected keys are shuffled, as SHA-256 digests, for the
exact count of documents and the choice of the kept occurrence. A false positive costs a shuffled row, never a wrong
answer.

The filter has about eight bits a line between 2**16 and ``max_filter_bits`` (2**26 bits, 8 MB: the only thing sent
to the driver and the executors, whatever the corpus). Past that size more keys are suspected, up to all of them, and
the operator becomes the plain exact aggregation of 32-byte digests; results never change.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, joined, written

#: White space stripped from both ends of a line to form its key (fixed values).
STRIPPED = b" \t\n\x0b\x0c\r"
SEGMENT = 1 << 16


def line_key(line: bytes) -> bytes:
    """The key of a UTF-8 line: stripped of ASCII white space, A-Z lower-cased, all else as it is."""
    return line.strip(STRIPPED).lower()


def long_enough(key: bytes, min_chars: int) -> bool:
    """Whether a key has ``min_chars`` code points, decoded only where its bytes don't tell."""
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def _keys(text: bytes | None, min_chars: int) -> set[bytes]:
    return {k for k in map(line_key, (text or b"").split(b"\n")) if long_enough(k, min_chars)}


def _positions(keys, bits: int) -> np.ndarray:
    """Two filter positions for each key."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)
    return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(32)) * np.uint64(0x9E3779B1) & np.uint64(bits - 1)], axis=1)


def _fold(once: np.ndarray, twice: np.ndarray, positions: np.ndarray) -> None:
    found, counts = np.unique(positions, return_counts=True)
    twice[found] |= once[found] | (counts > 1)
    once[found] = True


def twice_seen_filter(docs: DataFrame, text_col: str, bits: int, min_chars: int) -> np.ndarray:
    """The packed twice-seen filter of all documents (``bits / 8`` bytes)."""
    width = min(SEGMENT, bits)

    def notes(batches):
        once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        for batch in batches:
            pending: list[np.ndarray] = []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                if keys := _keys(text, min_chars):
                    # the two bits of one key may coincide; a document counts once for each bit
                    pending.append(np.unique(_positions(keys, bits)))
                if len(pending) >= 512:
                    _fold(once, twice, np.concatenate(pending))
                    pending = []
            if pending:
                _fold(once, twice, np.concatenate(pending))
        for k in range(bits // width):
            part = slice(k * width, (k + 1) * width)
            if once[part].any():
                yield pa.RecordBatch.from_pydict(
                    {"segment": pa.array([k], pa.int32()), "once": [_pack(once[part])], "twice": [_pack(twice[part])]}
                )

    def merged(batches):
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                o, t = _unpack(row["once"], width), _unpack(row["twice"], width)
                if row["segment"] in total:
                    have = total[row["segment"]]
                    have[1] |= t | (have[0] & o)
                    have[0] |= o
                else:
                    total[row["segment"]] = [o, t]
        for k, (o, t) in total.items():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([k], pa.int32()), "once": [_pack(o)], "twice": [_pack(t)]})

    schema = "segment int, once binary, twice binary"
    spark = docs.sparkSession
    partial = docs.select(text_col).mapInArrow(notes, schema)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = np.zeros((bits // width, width // 8), np.uint8)
    # each segment's partial pairs are folded as they arrive: memory is one pair per segment
    for row in partial.repartition(parts, "segment").mapInArrow(merged, schema).select("segment", "twice").toLocalIterator():
        out[row["segment"]] = np.packbits(_unpack(row["twice"], width))
    return out.reshape(-1)


def _pack(bits: np.ndarray) -> bytes:
    """A bit array as its set positions where these are shorter, else as it is."""
    at = np.flatnonzero(bits)
    return b"S" + at.astype("<u2").tobytes() if len(at) * 16 < len(bits) else b"B" + np.packbits(bits).tobytes()


def _unpack(raw: bytes, width: int) -> np.ndarray:
    if raw[:1] == b"B":
        return np.unpackbits(np.frombuffer(raw, np.uint8, offset=1)).astype(bool)[:width]
    out = np.zeros(width, bool)
    out[np.frombuffer(raw, "<u2", offset=1)] = True
    return out


def filter_bits(lines: int, max_filter_bits: int) -> int:
    return 1 << min(max(16, math.ceil(math.log2(max(1, lines) * 8))), int(math.log2(max_filter_bits)))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, max_filter_bits: int = 1 << 26, hub: int = 50_000
) -> DataFrame:
    """``docs`` with repeated lines removed from ``text_col``, plus ``n_lines`` and ``n_dropped``.

    A line whose key has ``min_chars`` code points and stands in ``min_docs`` documents stays only in the document
    of the largest id that holds it (there, every time it stands). Null or empty text: one empty line, kept. Rows
    that share an id count as one document and are treated alike; rows without an id count as one document below
    all others. An empty table gives no rows. Column order and other columns stay; helper columns avoid names already taken, and a column of ``docs``
    called n_lines or n_dropped is replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    lines = docs.select(F.sum(F.coalesce(F.length(text_col) - F.length(F.replace(text_col, F.lit("\n"), F.lit(""))), F.lit(0)) + 1)).first()[0] or 0
    bits = filter_bits(lines, max_filter_bits)
    suspects = spark.sparkContext.broadcast(twice_seen_filter(docs, text_col, bits, min_chars).tobytes())

    def suspected(text: bytes | None, seen: np.ndarray) -> list[bytes]:
        """The keys of a text whose bits all stand in the filter."""
        keys = list(_keys(text, min_chars))
        if not keys:
            return keys
        p = _positions(keys, bits)
        hit = ((seen[p >> np.uint64(3)] >> (7 - (p & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)
        return [keys[i] for i in np.flatnonzero(hit).tolist()]

    def digests(batches):
        seen = np.frombuffer(suspects.value, np.uint8)
        for batch in batches:
            at, found = [], []
            for row, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                keys = suspected(text, seen)
                at += [row] * len(keys)
                found += [hashlib.sha256(k).digest() for k in keys]
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found, pa.binary())], ["id", "mark", "key"])

    did, mark, own, keys = free_name(docs, "drop_id", "drop_mark", "text_mark", "drop_keys")
    marked = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    names = docs.columns
    text_at, width = names.index(text_col), len(names)

    def parted(clean: bool):
        """The rows without a suspected key, finished; or the others, as they are."""

        def run(batches):
            seen = np.frombuffer(suspects.value, np.uint8)
            for batch in batches:
                texts = batch.column(text_at).cast(pa.binary()).to_pylist()
                rows = [i for i, text in enumerate(texts) if bool(suspected(text, seen)) != clean]
                part = batch.take(pa.array(rows, pa.int64()))
                if clean:
                    yield from kept([pa.RecordBatch.from_arrays([*part.columns[:width], pa.nulls(len(rows), pa.list_(pa.binary()))], [*names, keys])])
                else:
                    yield part

        return run

    def kept(batches):
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, gone in zip(batch.column(text_at).cast(pa.binary()).to_pylist(), batch.column(width).to_pylist(), strict=True):
                text = text or b""
                n_lines.append(text.count(b"\n") + 1)
                left = n_lines[-1]
                if gone:
                    gone = set(gone)
                    rows = [r for r in text.split(b"\n") if not long_enough(k := line_key(r), min_chars) or hashlib.sha256(k).digest() not in gone]
                    left, text = len(rows), b"\n".join(rows)
                texts.append(text)
                n_dropped.append(n_lines[-1] - left)
            columns = [batch.column(i) if i != text_at else pa.array(texts, pa.binary()).cast(pa.string()) for i in range(width)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    id_type = docs.schema[id_col].dataType.simpleString()
    held = written(marked.select(id_col, own, text_col).mapInArrow(digests, f"id {id_type}, mark long, key binary"), "line-suspects")
    holders = held.groupBy("key", "id").agg(F.count("*").alias("rows"))
    repeated = holders.groupBy("key").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    repeated = written(repeated.select("key", "rows", "keeper"), "repeated-lines")
    lost = joined(held, repeated, "key", "rows", hub).where(~F.col("id").eqNullSafe(F.col("keeper")))
    # rows that share an id, or have none, each get the lines of their own text
    dropped = lost.groupBy(F.col("id").alias(did), F.col("mark").alias(mark)).agg(F.collect_set("key").alias(keys))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    meets = F.col(id_col).eqNullSafe(F.col(did)) & (F.col(own) == F.col(mark))
    some = marked.mapInArrow(parted(False), f"{fields}, `{own}` bigint").join(dropped, meets, "left").drop(did, mark, own)
    out = f"{fields}, n_lines bigint, n_dropped bigint"
    return marked.mapInArrow(parted(True), out).unionByName(some.mapInArrow(kept, out))
