"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Fingerprints at two or fewer differing bits differ in at most one
bit of some segment, so each distinct fingerprint is indexed under the 64 variants "segment with bit i wild"; equal
variants are joined and the candidates verified by ``bit_count(a ^ b)``.

A variant held by more than ``max_bucket`` distinct fingerprints is not expanded into pairs. Its fingerprints are linked
exactly another way: two fingerprints are within two bits if and only if they share a point at one bit or less from both,
so each emits itself and its 64 one-bit neighbours, and equal points are linked to the smallest holder. Links between
members of such a bucket are all found so, and every other link is found in a small bucket. Rows grow with the number of
fingerprints, never with the square of a group.

Two bits hold copies that are all but equal. Texts whose five-word shingles have a Jaccard similarity of 0.8 differ in some ten bits,
where segments of a 64-bit fingerprint don't select any more, so ``drop_near_duplicates`` finds these another way where it is
asked to: by the prefix filter, which is exact, and every candidate pair is verified on its whole shingle sets.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..control.files import freed_shuffles
from .common import discard, free_name, joined, slices, text_buffers, to_all, written
from .tokens import ASCII_LOWER, mix, span_hashes, word_spans


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash: a bit is 1 if set in over half of the shingles' XXH64 (seed 42); no words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    digest, ends = xxhash.xxh64_intdigest, ends[shingle - 1 :].tolist()
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 8192):
        ones += np.unpackbits(h[lo : lo + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str, out: str, shingle: int = 3) -> DataFrame:
    """``docs`` with its fingerprint as a long (the same 64 bits) in column ``out``; the text column is dropped."""
    others = [c for c in docs.columns if c != text_col]

    def hashed(batches):
        for batch in batches:
            values = np.fromiter((fingerprint(t, shingle) for t in batch.column(len(others)).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(values.view(np.int64))], [*others, out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col]
    return docs.select(*others, text_col).mapInArrow(hashed, ", ".join([*fields, f"`{out}` bigint"]))


def _bucket_scan(max_bucket: int):
    """Reads rows sorted by bucket: verified pairs of small buckets, and the fingerprints of larger ones (``b`` null)."""

    def scan(batches):
        carried, large = (np.zeros(0, np.int64), np.zeros(0, np.int64)), None

        def found(key, fp, hot_key):
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.append(head, len(key)))
            hot = np.repeat((size > max_bucket) | (key[head] == hot_key if hot_key is not None else False), size) if len(key) else np.zeros(0, bool)
            some = np.repeat(size > 1, size) & ~hot if len(key) else hot
            k, f = key[some], fp[some]
            near = []
            for d in range(1, max_bucket):
                if len(k) <= d:
                    break
                at = np.flatnonzero((k[d:] == k[:-d]) & (np.bitwise_count(f[d:].view(np.uint64) ^ f[:-d].view(np.uint64)) <= 2))
                near.append((f[at], f[at + d]))
            a = np.concatenate([x for x, _ in near] or [k[:0]])
            b = np.concatenate([y for _, y in near] or [k[:0]])
            big = np.unique(fp[hot])
            low, high = np.minimum(a, b), np.maximum(a, b)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([low, big])), pa.concat_arrays([pa.array(high), pa.nulls(len(big), pa.int64())])], ["a", "b"])

        for batch in batches:
            key, fp = (np.concatenate([c, batch.column(i).to_numpy()]) for i, c in enumerate(carried))
            if not len(key):
                continue
            # the last bucket may go on in the next batch; one too large already needn't be kept
            last = int(np.searchsorted(key, key[-1]))
            if len(key) - last > max_bucket or key[-1] == large:
                yield found(key, fp, large)
                large, carried = key[-1], (key[:0], fp[:0])
            else:
                yield found(key[:last], fp[:last], large)
                large, carried = None, (key[last:], fp[last:])
        yield found(*carried, large)

    return scan


def links(points: DataFrame, max_bucket: int = 32) -> DataFrame:
    """Edges ``a < b`` over distinct 64-bit ``fp`` that connect exactly the fingerprints within two bits.

    The index is shuffled once, 16 bytes a variant, and scanned in bucket order with at most one small bucket in memory.
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = F.lit(1).cast("long")
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    variants = lambda part, first: F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long")),
        lambda i: F.call_function("shiftleft", i + first, F.lit(32)).bitwiseOR(part.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", one, i.cast("int"))))),
    )
    indexed = points.repartition(parts, "fp").select(F.explode(F.concat(variants(low, 0), variants(high, 32))).alias("bucket"), "fp")
    spread = indexed.repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = written(spread.mapInArrow(_bucket_scan(max_bucket), "a long, b long").distinct(), "buckets")
    hot = found.where("b is null").select(F.col("a").alias("fp"))
    ball = F.explode(F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", one, i)))))
    around = hot.repartition(parts, "fp").select("fp", ball.alias("point"))
    centre = around.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z")
    starred = around.join(centre, "point").where("fp > a").select("a", F.col("fp").alias("b"))
    edges = written(found.where("b is not null").unionByName(starred).distinct(), "links")
    discard(found)
    return edges


def components(edges: DataFrame, rounds: int = 50, hub: int = 50_000) -> DataFrame:
    """``node, root`` for every node of an edge: its component's smallest node.

    Alternating large-star and small-star steps, each a shuffle of the edges with map-side minima; every round is
    written, in place of the one before, and their number grows with the logarithm of the longest chain. The minima of nodes of over ``hub`` edges are
    broadcast, so a star's edges never meet in one task.
    """
    edges = written(edges.select("a", "b"), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = joined(both, least, "a", "n", hub).where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        small = joined(large, down, "b", "n", hub).select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x < y")
        old, edges = edges, written(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            stars = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
            found = written(stars.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()), "roots")
            discard(edges)
            return found
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bucket: int = 32, hub: int = 50_000) -> DataFrame:
    """One row per input row: ``id_col, fingerprint`` (16 hex digits) and ``component_id``.

    The component id is the smallest id reachable over links of two or fewer differing bits, the row's own included.
    Null or empty text has fingerprint zero and is linked like any other. Rows without an id take part and get the
    smallest id of their component, null if it has none. Repeated rows stay. An empty table gives no rows. Other columns are not
    read. Fingerprints of over ``hub`` rows, and components of over ``hub`` fingerprints, are joined by broadcast.
    """
    found, _ = _named(docs, id_col, text_col, shingle, max_bucket, hub)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bucket: int, hub: int) -> tuple[DataFrame, list[DataFrame]]:
    """``id, mark`` (hash of the text)``, fp, component_id`` and the component's least ``mark``, a row for each of ``docs``; tables it reads."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), F.col(text_col).alias("text"))
    fp = written(fingerprints(rows, "text", "fp", shingle), "fingerprints")
    points = written(fp.groupBy("fp").agg(F.min("id").alias("least"), F.min("mark").alias("least_mark"), F.count("*").alias("rows")), "fingerprint-points")
    edges = links(points.select("fp"), max_bucket)
    reach = components(edges, hub=hub)
    ids = written(points.join(reach, points["fp"] == reach["node"], "left").select("fp", "least", "least_mark", "rows", F.coalesce("root", "fp").alias("root")), "fingerprint-roots")
    discard(points, edges, reach)
    roots = written(ids.groupBy("root").agg(F.min("least").alias("component_id"), F.min("least_mark").alias("component_mark"), F.count("*").alias("points")), "component-ids")
    named = joined(ids.select("fp", "rows", "root"), roots, "root", "points", hub)
    return joined(fp, named.select("fp", "component_id", "component_mark", "rows"), "fp", "rows", hub), [fp, ids, roots]


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bucket: int = 32, hub: int = 50_000, similarity: float | None = None, similar_shingle: int = 5
) -> DataFrame:
    """``docs`` without the rows whose id is not the smallest of their component.

    With ``similarity`` the rows that stay are then linked where their sets of ``similar_shingle`` words are that similar, and of each
    such component the smallest id stays, too. Rows are told apart by id and text: of rows that share an id, one goes only if its own
    component has a smaller id. A row without an id goes if its component has one; of a component without ids one text
    stays. Repeated rows stay together. Null and empty texts are one component. An empty table gives no rows.
    """
    if similarity is None:
        return _without(docs, written(_losers(_named(docs, id_col, text_col, shingle, max_bucket, hub)[0]), "near-copies"), id_col, text_col)
    with freed_shuffles(docs.sparkSession):
        found, held = _named(docs, id_col, text_col, shingle, max_bucket, hub)
        gone = written(_losers(found), "near-copies")
        discard(*held)
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = written(_without(docs.select(id_col, text_col), gone, id_col, text_col).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text")), "fingerprints-apart")
        edges = similar(rows.select("mark", "text"), similarity, similar_shingle, max_bucket, hub)
        reach = components(edges, hub=hub)
        named = rows.select("id", "mark").join(reach.withColumnRenamed("node", "mark"), "mark")
        roots = written(named.groupBy("root").agg(F.min("id").alias("component_id"), F.min("mark").alias("component_mark"), F.count("*").alias("rows")), "similar-ids")
        more = written(_losers(joined(named, roots, "root", "rows", hub)), "similar-copies")
        discard(rows, edges, reach, roots)
    return _without(docs, gone.unionByName(more), id_col, text_col)


def _losers(found: DataFrame) -> DataFrame:
    """``gone, gone_mark`` of the rows of ``found`` (``id, mark, component_id, component_mark``) that another row of their component stands for."""
    nameless = F.col("id").isNull() & (F.col("component_id").isNotNull() | (F.col("mark") > F.col("component_mark")))
    return found.where(nameless | (F.col("id") > F.col("component_id"))).select(F.col("id").alias("gone"), F.col("mark").alias("gone_mark")).distinct()


def _without(docs: DataFrame, losers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without ``losers``, which are written."""
    gone, mark, own = free_name(docs, "gone_id", "gone_mark", "text_mark")
    losers = to_all(losers.select(F.col("gone").alias(gone), F.col("gone_mark").alias(mark)))
    marked = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return marked.join(losers, F.col(id_col).eqNullSafe(F.col(gone)) & (F.col(own) == F.col(mark)), "left_anti").drop(own)


#: One text in so many tells which shingles are frequent; words that a worker gathers before it sends them on; bytes of text a bin.
LOOKED_AT, GATHERED, BIN_BYTES = 16, 1 << 20, 1 << 24
#: What is compared key by key is shuffled in slices of keys, each of at most this part of the texts' bytes.
SLICE = 2


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``shingle`` lower-cased words of each row (of fewer words: all of them), and each row's first."""
    data = ASCII_LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words, n = span_hashes(data, starts, ends), np.diff(first)
    size = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    bag = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(first[:-1] - bag[:-1], size) + np.arange(bag[-1])
    left = np.repeat(first[1:], size) - at
    out = np.zeros(len(at), np.uint64)
    for k in range(shingle):
        inside = left > k
        out[inside] = mix(out[inside] * np.uint64(3) + words[at[inside] + k])
    return out, bag


def prefix_size(n: int, similarity: float) -> int:
    """How many of ``n`` shingles, the first in any order of all, two similar sets can't both have without one in common."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def _sets(batches, shingle: int):
    """``row's mark, its distinct shingle hashes in ascending order`` for all rows that have words."""
    for batch in batches:
        marks = batch.column(0).to_numpy()
        data, offsets = text_buffers(batch.column(1))
        for lo, hi in slices(offsets):
            hashes, bag = shingle_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shingle)
            for row in np.flatnonzero(np.diff(bag)).tolist():
                yield marks[lo + row], np.unique(hashes[bag[row] : bag[row + 1]])


def _in_bins(similarity: float, shingle: int, bins: int, frequent):
    """Reads ``mark, text``: packed prefixes by bin, and, in bins under zero, what the packed row numbers stand for.

    A packed shingle is 40 bits of its key and 24 of its row's number, and a byte for its place in the prefix, in 256ths rounded down:
    9 bytes, where a Spark row takes three times that.
    """

    def packed(batches):
        late = np.frombuffer(frequent.value, np.uint64)
        keys, marks, sizes, held = [], [], [], 0

        def sent():
            mark, size = np.array(marks, np.int64), np.array(sizes, np.int64)
            row = np.repeat(np.arange(len(keys), dtype=np.uint64), [len(k) for k in keys])
            key = mix(np.concatenate(keys))
            place = np.concatenate([np.arange(len(k)) * 256 // len(k) for k in keys]).astype(np.uint8)
            source = int(mix(mark.view(np.uint64) + mix(np.arange(len(mark), dtype=np.uint64))).sum(dtype=np.uint64).astype(np.int64))
            bin_of = ((key & np.uint64(0xFFFFFF)) % np.uint64(bins)).astype(np.int64)
            cell = key >> np.uint64(24) << np.uint64(24) | row
            order = np.lexsort((cell, bin_of))
            cell, bin_of, place = cell[order], bin_of[order], place[order]
            there, first = np.unique(bin_of, return_index=True)
            last = np.append(first[1:], len(cell))
            blobs = [cell[i:j].tobytes() + place[i:j].tobytes() for i, j in zip(first.tolist(), last.tolist(), strict=True)]
            names = np.concatenate([mark, size]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([*there.tolist(), -1 - source % bins], pa.int64()), pa.array([source] * (len(blobs) + 1), pa.int64()), pa.array([*blobs, names], pa.binary())], ["bin", "source", "cells"])

        for mark, hashes in _sets(batches, shingle):
            n = len(hashes)
            if len(late):
                is_late = late[np.minimum(np.searchsorted(late, hashes), len(late) - 1)] == hashes
                hashes = np.concatenate([hashes[~is_late], hashes[is_late]])
            keys.append(hashes[: prefix_size(n, similarity)].copy())
            marks.append(mark)
            sizes.append(n)
            held += len(keys[-1])
            if held >= GATHERED or len(keys) >= 1 << 23:
                yield from sent()
                keys, marks, sizes, held = [], [], [], 0
        if keys:
            yield from sent()

    return packed


def _shared(bins: int):
    """Reads ``bin, source, cells`` sorted by bin: ``key, source, row, place`` of keys that several rows have; ``mark, size`` of each row (``key`` null)."""

    def batch(*columns):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) if not isinstance(x, pa.Array) else x for x in columns], ["key", "source", "row", "place", "mark", "size"])

    def met(at, sources, cells):
        if at < 0:
            for source, raw in zip(sources, cells, strict=True):
                mark, size = np.frombuffer(raw, np.int64).reshape(2, -1)
                yield batch(pa.nulls(len(mark), pa.int64()), np.full(len(mark), source), np.arange(len(mark)), pa.nulls(len(mark), pa.int64()), mark, size)
            return
        cell = np.concatenate([np.frombuffer(c, np.uint64, len(c) // 9) for c in cells])
        place = np.concatenate([np.frombuffer(c, np.uint8, offset=len(c) // 9 * 8) for c in cells])
        source = np.repeat(np.array(sources, np.int64), [len(c) // 9 for c in cells])
        key = cell >> np.uint64(24)
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = key[1:] == key[:-1]
        several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        at_all = order[several]
        none = pa.nulls(len(at_all), pa.int64())
        yield batch((key[several].astype(np.int64) << 22) | at, source[at_all], (cell[at_all] & np.uint64(0xFFFFFF)).astype(np.int64), place[at_all].astype(np.int64), none, none)

    def scan(batches):
        at, sources, cells = None, [], []
        for rows in batches:
            for b, source, raw in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
                if b != at and cells:
                    yield from met(at, sources, cells)
                    sources, cells = [], []
                at = b
                sources.append(source)
                cells.append(raw)
        if cells:
            yield from met(at, sources, cells)

    return scan


def _overlaps(sets: list[np.ndarray]):
    """A function of ``i`` that gives how many values each of ``sets`` has in common with the ``i``-th, by lists of who has a value."""
    bag = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    count = np.bincount(at, minlength=len(values))
    first = np.cumsum(count) - count
    holders = np.repeat(np.arange(len(sets)), np.diff(bag))[np.argsort(at, kind="stable")]

    def of(i: int) -> np.ndarray:
        own = at[bag[i] : bag[i + 1]]
        own = own[count[own] > 1]
        n = count[own]
        return np.bincount(holders[np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))

    return of


def _by_root(root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, by root with the largest last, and for each row in it where the next root begins."""
    _, name, size = np.unique(root, return_inverse=True, return_counts=True)
    order = np.lexsort((name, size[name]))
    own = name[order]
    ends = np.flatnonzero(np.append(own[1:] != own[:-1], True)) + 1
    return order, np.repeat(ends, np.diff(np.concatenate([[0], ends])))


def _buckets(batches, names: list[str], of):
    """Batches of what ``of(key, columns)`` gives for the rows of each key, of batches sorted by the first column."""
    held = None
    for rows in batches:
        rows = pa.Table.from_batches([rows])
        held = rows if held is None else pa.concat_tables([held, rows])
        key = held.column(0).to_numpy()
        if not len(key) or key[0] == key[-1]:
            continue
        last = int(np.searchsorted(key, key[-1]))
        yield from _flushed(held.slice(0, last), key[:last], names, of)
        held = held.slice(last)
    if held is not None and len(held):
        yield from _flushed(held, held.column(0).to_numpy(), names, of)


def _flushed(held: pa.Table, key: np.ndarray, names: list[str], of):
    edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
    held = held.combine_chunks()
    found = [x for lo, hi in zip(edges[:-1], edges[1:], strict=True) if (x := of(int(key[lo]), [held.column(i).slice(lo, hi - lo) for i in range(1, held.num_columns)])) is not None]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)], names)


def _possible(similarity: float, one: np.ndarray, two: np.ndarray, both: np.ndarray) -> np.ndarray:
    """If texts of ``one`` and ``two`` shingles can be similar where their prefixes have ``both`` in common.

    One of the two prefixes reaches less far in the order; its text has nothing in common with the other beyond ``both`` and what isn't in it.
    """
    reach = lambda n: np.ceil(similarity * n - 1e-9) - 1  # noqa: E731  what isn't in the prefix
    sizes = np.minimum(one, two) >= similarity * np.maximum(one, two) - 1e-9
    return sizes & (both + np.maximum(reach(one), reach(two)) >= similarity / (1 + similarity) * (one + two) - 1e-6)


def _meetable(similarity: float, one: np.ndarray, two: np.ndarray, place_one: np.ndarray, place_two: np.ndarray) -> np.ndarray:
    """If texts of ``one`` and ``two`` shingles can be similar where a key at these places (256ths of a prefix) is the first of all that both have.

    What they have in common then lies from there on, in either.
    """
    from_there = lambda n, place: n - np.ceil(place * (n - np.ceil(similarity * n - 1e-9) + 1) / 256 - 1e-9)
    sizes = np.minimum(one, two) >= similarity * np.maximum(one, two) - 1e-9
    return sizes & (np.minimum(from_there(one, place_one), from_there(two, place_two)) >= similarity / (1 + similarity) * (one + two) - 1e-6)


def _meeting_centres(similarity: float):
    """Reads ``a, b`` and ``size * 256 + place`` of both under a key: the pairs that may have it as the first of all in common."""

    def fitting(batches):
        for batch in batches:
            one, two = (batch.column(i).to_numpy() for i in (2, 3))
            at = pa.array(np.flatnonzero(_meetable(similarity, one >> 8, two >> 8, one & 255, two & 255)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    return fitting


def _near(similarity: float):
    """Reads ``key, root, mark, cell`` sorted by key (``cell``: ``size * 256 + place``): ``key, root, mark`` of texts with a partner of
    another root that may have this key as the first of all in common with them. The text of the least mark has been compared with all."""

    def of(key, columns):
        root, mark, cell = (columns[i].to_numpy() for i in range(3))
        others = np.flatnonzero(mark != mark.min())
        if not len(others):
            return None
        order, later = _by_root(root[others])
        order = others[order]
        size, place = cell[order] >> 8, cell[order] & 255
        wanted = np.zeros(len(order), bool)
        for i in range(len(order)):
            if later[i] == len(order):
                break
            fits = _meetable(similarity, size[later[i] :], size[i], place[later[i] :], place[i])
            wanted[later[i] :] |= fits
            wanted[i] |= fits.any()
        order = order[wanted]
        return (np.full(len(order), key), root[order], mark[order]) if len(order) else None

    return lambda batches: _buckets(batches, ["key", "root", "mark"], of)


def _partners(similarity: float):
    """Reads ``key, root, mark, keys`` sorted by key (``keys``: how many of the text's keys have come so far, these, its size, all its keys):
    ``key, root, mark`` of texts with a partner of another root that they can be similar to, under the least key under which both have
    come so far. A row for each text, not for each pair."""

    def of(key, columns):
        root, mark = columns[0].to_numpy(), columns[1].to_numpy()
        order, later = _by_root(root)
        if later[0] == len(order):
            return None
        every = columns[2].combine_chunks() if isinstance(columns[2], pa.ChunkedArray) else columns[2]
        sets = [every[i].values.to_numpy() for i in order.tolist()]
        here = [x[1 : 1 + x[0]] for x in sets]
        size = np.array([x[1 + x[0]] for x in sets])
        all_of = _overlaps([x[2 + x[0] :] for x in sets])
        less_of = _overlaps([x[x < key] for x in here])
        wanted = np.zeros(len(order), bool)
        for i in range(len(order)):
            if later[i] == len(order):
                break
            fits = _possible(similarity, size, size[i], all_of(i)) & (less_of(i) == 0)
            fits[: later[i]] = False
            wanted |= fits
            wanted[i] |= fits.any()
        order = order[wanted]
        return (np.full(len(order), key), root[order], mark[order]) if len(order) else None

    return lambda batches: _buckets(batches, ["key", "root", "mark"], of)


def _compared(similarity: float, shingle: int):
    """Reads ``key, root, mark, text`` sorted by key: edges ``a, b`` that connect the similar texts of a key that aren't linked."""

    def of(key, columns):
        root, mark = columns[0].to_numpy(), columns[1].to_numpy()
        order, later = _by_root(root)
        if later[0] == len(order):
            return None
        sets = [np.unique(_shingles_of(columns[2][i].as_py(), shingle)) for i in order.tolist()]
        size, mark = np.array([len(x) for x in sets]), mark[order]
        linked = np.unique(root[order], return_inverse=True)[1]
        both_of = _overlaps(sets)
        found = []
        for i in range(len(order)):
            if later[i] == len(order):
                break
            both = both_of(i)
            alike = (both >= similarity * (size + size[i] - both) - 1e-9) & (linked != linked[i])
            to, at = np.unique(linked[alike], return_index=True)
            if len(to):
                found.append((np.full(len(at), mark[i]), mark[np.flatnonzero(alike)[at]]))
                linked[np.isin(linked, to)] = linked[i]
        if not found:
            return None
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return np.minimum(a, b), np.maximum(a, b)

    return lambda batches: _buckets(batches, ["a", "b"], of)


def similar(texts: DataFrame, similarity: float = 0.8, shingle: int = 5, max_bucket: int = 32, hub: int = 50_000) -> DataFrame:
    """Edges ``a < b`` over ``mark`` of ``mark, text`` between distinct texts whose shingle sets have that Jaccard similarity.

    Their components are those of all such pairs; pairs that are linked already, however indirectly, are left out. Two similar sets
    have a shingle in common among the first fifth of each (:func:`prefix_size`) in one order of all shingles. These prefixes are
    shuffled once, packed, and texts that share a key are candidates. The order is that of the hashes, with shingles last that over
    some ``2 * max_bucket`` texts seem to have; which these are, is told from some of the texts and changes no result.

    First each key's texts are compared with one of them, and keys whose texts are all linked by then go, so copies by the thousand are
    not compared with one another. Of what is left all pairs of texts that aren't linked are compared, without exception, within the
    task that has the key, and no pair becomes a row: prefixes tell which can't be similar, the others are verified on whole texts.
    Every pair counts only under keys that can be the first in the order that it has in common, which sizes and places tell (the
    positional filter, exact as well): a text's keys are only sent to where such a pair is.
    A text of over ``hub`` candidates is broadcast to them if it is of at most 64 KB (1000 texts at most).
    """
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = texts.select("mark", "text")
    whole_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bins = min(max(parts, whole_bytes // BIN_BYTES), 1 << 21)

    def begins(batches):
        for mark, hashes in _sets(batches, shingle):
            yield pa.RecordBatch.from_arrays([pa.array(hashes[: 2 * prefix_size(len(hashes), similarity)].view(np.int64))], ["h"])

    seen = texts.where(F.pmod("mark", F.lit(LOOKED_AT)) == 0).mapInArrow(begins, "h long").groupBy("h").agg(F.count("*").alias("n"))
    late = seen.where(F.col("n") >= max(2, 2 * max_bucket // LOOKED_AT)).orderBy(F.desc("n"), "h").limit(100_000).select("h").toArrow().column(0).to_numpy()
    frequent = spark.sparkContext.broadcast(np.sort(late.astype(np.int64).view(np.uint64)).tobytes())

    packed = texts.mapInArrow(_in_bins(similarity, shingle, bins, frequent), "bin long, source long, cells binary")
    met = written(packed.repartition(parts, "bin").sortWithinPartitions("bin").mapInArrow(_shared(bins), "key long, source long, row long, place long, mark long, size long"), "shared-keys")
    names = met.where("key is null").select("source", "row", "mark", "size").distinct()
    cell = (F.col("size") * 256 + F.col("place")).alias("cell")
    rows = written(met.where("key is not null").select("key", "source", "row", "place").join(names, ["source", "row"]).select("key", "mark", cell).groupBy("key", "mark").agg(F.min("cell").alias("cell")), "shared-rows")
    discard(met)
    sets = written(rows.groupBy("mark").agg(F.first(F.shiftright("cell", 8)).alias("size"), F.array_sort(F.collect_set("key")).alias("keys")).select("mark", F.concat(F.array("size"), "keys").alias("keys")), "shared-sets")

    def meeting(left: DataFrame, right: DataFrame, value: str, fits) -> DataFrame:
        """``left`` with the value of ``right`` (one row a ``mark``) for ``b``, and for ``a``, the side that may be a star's centre."""
        sizes = left.groupBy("a").agg(F.count("*").alias("n"))
        first = right.select(F.col("mark").alias("a"), F.col(value).alias(f"{value}_a")).join(sizes, "a")
        second = right.select(F.col("mark").alias("b"), F.col(value).alias(f"{value}_b"))
        return joined(left.join(second, "b"), first, "a", "n", hub, 1000, fits).select("a", "b", f"{value}_a", f"{value}_b")

    def possible(batches):
        for batch in batches:
            kept = []
            for at in range(batch.num_rows):
                one, two = (batch.column(i)[at].values.to_numpy() for i in (2, 3))
                if _possible(similarity, one[0], two[0], len(np.intersect1d(one[1:], two[1:], assume_unique=True))):
                    kept.append(at)
            kept = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], ["a", "b"])

    def alike(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                one, two = (np.unique(_shingles_of(batch.column(i)[at].as_py(), shingle)) for i in (2, 3))
                both = len(np.intersect1d(one, two, assume_unique=True))
                if both >= similarity * (len(one) + len(two) - both) - 1e-9:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), batch.column(1).slice(at, 1)], ["a", "b"])

    def texts_of(marks: DataFrame, label: str) -> DataFrame:
        marks = written(marks.distinct(), "marks")
        found = written(texts.join(to_all(marks), "mark", "left_semi").dropDuplicates(["mark"]), label)
        discard(marks)
        return found

    def verified(pairs: DataFrame) -> DataFrame:
        some = written(meeting(pairs, sets, "keys", F.size("keys_a") <= 1 << 13).mapInArrow(possible, "a long, b long"), "similar-candidates")
        whole = texts_of(some.select(F.explode(F.array("a", "b")).alias("mark")), "similar-texts")
        found = written(meeting(some, whole, "text", F.octet_length("text_a") <= 1 << 16).mapInArrow(alike, "a long, b long"), "similar-edges")
        discard(pairs, some, whole)
        return found

    centres = written(rows.groupBy("key").agg(F.min("mark").alias("centre"), F.min_by("cell", "mark").alias("its"), F.count("*").alias("n")).where("n > 1"), "centres")
    met = joined(rows, centres, "key", "n", hub).where("mark <> centre").select(F.col("centre").alias("a"), F.col("mark").alias("b"), "its", "cell")
    edges = verified(written(met.mapInArrow(_meeting_centres(similarity), "a long, b long").distinct(), "similar-pairs"))
    discard(centres)
    reach = components(edges, hub=hub)
    root = reach.select(F.col("node").alias("mark"), "root")
    # marks stand for themselves where nothing links them
    rooted = written(rows.join(root, "mark", "left").select("key", "mark", "cell", F.coalesce("root", "mark").alias("root")), "similar-roots")
    discard(rows, reach)
    several = written(rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n")).where("least < most and n > 2"), "apart-keys")
    apart = joined(rooted, several, "key", "n", hub).select("key", "root", "mark", "cell")
    live = written(apart.repartition(parts, "key").sortWithinPartitions("key", "mark").mapInArrow(_near(similarity), "key long, root long, mark long"), "apart-rows")
    discard(rooted, several)
    here = live.groupBy("mark").agg(F.collect_set("key").alias("here"))
    held = written(here.join(sets, "mark").select("mark", F.concat(F.array(F.size("here").cast("long")), "here", "keys").alias("keys")), "apart-sets")
    discard(sets)

    def by_slices(left: DataFrame, right: DataFrame, value: str, size, run, schema: str) -> list[DataFrame]:
        """What ``run`` makes of ``left`` with the value of its mark in ``right``, sorted by key: a table for each slice of the keys."""
        moved = left.join(right.select("mark", size.alias("_size")), "mark").agg(F.sum("_size")).first()[0] or 0
        n = max(1, -(-moved * SLICE // max(whole_bytes, 1 << 24)))
        out = []
        for k in range(n):
            some = left.where(F.pmod(F.xxhash64("key"), F.lit(n)) == k).join(right, "mark").select("key", "root", "mark", value)
            out.append(written(some.repartition(parts, "key").sortWithinPartitions("key", "mark").mapInArrow(run, schema), "apart-slice"))
        return out

    def all_of(tables: list[DataFrame]) -> DataFrame:
        out = written(reduce(DataFrame.unionByName, tables), "apart-whole")
        discard(*tables)
        return out

    wanted = all_of(by_slices(live, held, "keys", 8 * F.size("keys"), _partners(similarity), "key long, root long, mark long"))
    discard(live, held)
    whole = texts_of(wanted.select("mark"), "apart-texts")
    found = by_slices(wanted, whole, "text", F.octet_length("text"), _compared(similarity, shingle), "a long, b long")
    out = all_of([edges, *found])
    discard(wanted, whole)
    return out


def _shingles_of(text: str | None, shingle: int) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return shingle_hashes(raw, np.array([0, len(raw)]), shingle)[0]
