"""Content-addressed checkpoints: chunks, manifests and a junction of positions; history, verification, retention, GC.

A payload is ``w, net, seq, data``. Chunks are keyed by SHA-256 and shared by everyone; a manifest lists hashes by position.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..control.errors import raise_error

OWNER = ["w", "net"]
DEFAULT_CHUNK, MAX_CHUNK = 4 << 20, 16 << 20


def check_options(chunk_size: int = DEFAULT_CHUNK, label: str | None = None, retain: int | None = None, limit: int | None = None) -> None:
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    if not whole(chunk_size) or not 1 <= chunk_size <= MAX_CHUNK:
        raise_error("VALIDATION_FAILED", f"chunk size {chunk_size!r}")
    if label is not None and (not label or len(label) > 200 or "\x00" in label):
        raise_error("VALIDATION_FAILED", "label")
    if retain is not None and (not whole(retain) or not 1 <= retain < 1 << 53):
        raise_error("VALIDATION_FAILED", f"retain {retain!r}")
    if limit is not None and (not whole(limit) or not 1 <= limit <= 1000):
        raise_error("VALIDATION_FAILED", f"limit {limit!r}")


def split(payloads: DataFrame, chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """``w, net, seq, position, hash, data, size_bytes``: fixed-size chunks, the last one short; none for an empty payload."""
    check_options(chunk_size)
    n = F.ceil(F.octet_length("data") / chunk_size).cast("int")
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    rows = payloads.select(*OWNER, "seq", "data", at.alias("position"))
    piece = F.substr(F.col("data"), F.col("position") * chunk_size + 1, F.lit(chunk_size))
    rows = rows.withColumn("data", piece)
    return rows.select(*OWNER, "seq", "position", F.sha2("data", 256).alias("hash"), "data", F.octet_length("data").alias("size_bytes"))


def chunk_pool(chunks: DataFrame, created: str = "created_at") -> DataFrame:
    """One row per hash: any of its equal data, the latest ``created_at`` (saving again refreshes the clock)."""
    return chunks.groupBy("hash").agg(F.any_value("data").alias("data"), F.max(created).alias("created_at"), F.any_value("size_bytes").alias("size_bytes"))


def manifest_hash(hashes) -> F.Column:
    """SHA-256 of the concatenated binary hashes of ``array<struct<position, hash>>``, in position order."""
    return F.sha2(F.unhex(F.array_join(F.transform(F.array_sort(hashes), lambda x: x["hash"]), "")), 256)


def manifests(payloads: DataFrame, junction: DataFrame) -> DataFrame:
    """``w, net, seq, manifest_hash, n_chunks``; an empty payload has the hash of nothing."""
    listed = junction.groupBy(*OWNER, "seq").agg(F.collect_list(F.struct("position", "hash")).alias("h"))
    out = payloads.select(*OWNER, "seq").join(listed, [*OWNER, "seq"], "left")
    h = F.coalesce("h", F.array().cast("array<struct<position:int,hash:string>>"))
    return out.select(*OWNER, "seq", manifest_hash(h).alias("manifest_hash"), F.size(h).cast("long").alias("n_chunks"))


def allocate(batch: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Next gapless ``seq`` per owner for a batch: the largest committed one plus the row's rank.

    Ranks are taken within ranges of ``order`` with range totals carried, so one owner's rows fill many tasks.
    """
    top = existing.groupBy(*OWNER).agg(F.max("seq").alias("_top"))
    rows = batch.withColumn("_r", F.pmod(F.floor(F.col(order) / 1024), F.lit(1 << 40)))
    sums = rows.groupBy(*OWNER, "_r").agg(F.count("*").alias("_n"))
    base = F.coalesce(F.sum("_n").over(Window.partitionBy(*OWNER).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*OWNER, "_r", base.alias("_base"))
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*OWNER, "_r").orderBy(order)))
    out = ranked.join(sums, [*OWNER, "_r"]).join(top, OWNER, "left")
    return out.withColumn("seq", (F.coalesce("_top", F.lit(0)) + F.col("_base") + F.col("_rn")).cast("long")).drop("_r", "_n", "_base", "_rn", "_top")


def load(man: DataFrame, seq: int | None = None) -> DataFrame:
    """Each owner's manifest of a sequence number, or its latest complete one."""
    done = man.where("complete")
    if seq is not None:
        return done.where(F.col("seq") == seq)
    others = [c for c in man.columns if c not in OWNER]
    best = done.groupBy(*OWNER).agg(F.max_by(F.struct(*others), "seq").alias("m"))
    return best.select(*OWNER, *[F.col(f"m.{c}").alias(c) for c in others])


def reassemble(man: DataFrame, junction: DataFrame, pool: DataFrame) -> DataFrame:
    """``w, net, seq, data, problem`` of each complete manifest: its chunks in position order, as one binary.

    An empty manifest has empty data. Where a position or a chunk is missing, or a chunk's hash is wrong, ``data`` is null and
    ``problem`` says so, as in :func:`verify`. Each chunk is rehashed once, before the join.
    """
    there = pool.select("hash", "data", (F.sha2("data", 256) == F.col("hash")).alias("_intact"))
    rows = junction.join(there, "hash", "left")
    per = rows.groupBy(*OWNER, "seq").agg(
        F.expr("listagg(data) within group (order by position)").alias("_data"), F.count("*").alias("_n"), F.count_distinct("position").alias("_d"), F.min("position").alias("_low"),
        F.max("position").alias("_top"), F.count_if(F.col("_intact").isNull()).alias("_missing"), F.count_if(~F.col("_intact")).alias("_broken"),
    )
    out = man.where("complete").select(*OWNER, "seq", "n_chunks").join(per, [*OWNER, "seq"], "left")
    n = F.coalesce("_n", F.lit(0))
    dense = (n == F.col("n_chunks")) & ((n == 0) | ((F.col("_d") == n) & (F.col("_low") == 0) & (F.col("_top") + 1 == n)))
    problem = F.when(~dense, "density").when(F.col("_missing") > 0, "chunk_missing").when(F.col("_broken") > 0, "chunk_hash")
    return out.select(*OWNER, "seq", F.when(problem.isNull(), F.coalesce("_data", F.lit("").cast("binary"))).alias("data"), problem.alias("problem"))


def verify(man: DataFrame, junction: DataFrame, pool: DataFrame) -> DataFrame:
    """``w, net, seq, problem`` of manifests that don't load: density, chunk_missing, chunk_hash or manifest_hash, in this order.

    The pool is rehashed once per chunk, before the join, however many manifests share it.
    """
    checked = pool.select("hash", F.lit(True).alias("there"), (F.sha2("data", 256) == F.col("hash")).alias("intact"))
    rows = junction.join(checked, "hash", "left")
    per = rows.groupBy(*OWNER, "seq").agg(
        F.max("position").alias("top"), F.count("*").alias("n"), F.count_distinct("position").alias("d"), F.min("position").alias("low"),
        F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(~F.col("intact")).alias("broken"),
        manifest_hash(F.collect_list(F.struct("position", "hash"))).alias("actual"),
    )
    both = man.where("complete").join(per, [*OWNER, "seq"], "left")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    problem = (
        F.when((F.col("n") > 0) & ((F.col("top") + 1 != F.col("n")) | (F.col("d") != F.col("n")) | (F.col("low") != 0)), "density")
        .when(F.col("missing") > 0, "chunk_missing")
        .when(F.col("broken") > 0, "chunk_hash")
        .when(F.coalesce("actual", empty) != F.col("manifest_hash"), "manifest_hash")
    )
    return both.select(*OWNER, "seq", problem.alias("problem")).where("problem is not null")


def page(man: DataFrame, junction: DataFrame, pool: DataFrame, w: str, net: str, limit: int = 50, before: int | None = None) -> DataFrame:
    """An owner's newest manifests with chunk counts and sizes, repeats counted; missing chunks don't count. ``data`` isn't read."""
    check_options(limit=limit)
    own = man.where((F.col("w") == w) & (F.col("net") == net) & F.col("complete"))
    own = own.where(F.col("seq") < before) if before is not None else own
    top = own.orderBy(F.desc("seq")).limit(limit)
    sizes = junction.join(F.broadcast(top.select(*OWNER, "seq")), [*OWNER, "seq"], "left_semi").join(pool.select("hash", "size_bytes"), "hash")
    sums = sizes.groupBy(*OWNER, "seq").agg(F.count("*").alias("n_chunks"), F.sum("size_bytes").alias("bytes"))
    out = top.select(*OWNER, "seq").join(sums, [*OWNER, "seq"], "left")
    return out.select(*OWNER, "seq", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes")).orderBy(F.desc("seq"))


def prunable(man: DataFrame, retain: int) -> DataFrame:
    """Manifests older than each owner's ``retain``-th newest complete one; none where there are fewer."""
    check_options(retain=retain)
    rank = F.row_number().over(Window.partitionBy(*OWNER).orderBy(F.desc("seq")))
    # only the newest ``retain`` per owner are ranked in full: Spark limits the window group before its shuffle
    edge = man.where("complete").withColumn("_r", rank).where(F.col("_r") <= retain)
    edge = edge.groupBy(*OWNER).agg(F.min("seq").alias("_edge"), F.count("*").alias("_c")).where(F.col("_c") == retain)
    return man.join(edge, OWNER).where(F.col("seq") < F.col("_edge")).drop("_edge", "_c")


def collectable(pool: DataFrame, live_junction: DataFrame, now: datetime, grace: str = "15 minutes") -> DataFrame:
    """Chunks that no live manifest lists and that are older than the grace time: a hash anti-join of narrow rows."""
    old = pool.where(F.col("created_at") < F.lit(now) - F.expr(f"interval {grace}"))
    return old.join(live_junction.select("hash"), "hash", "left_anti")


def prune_and_collect(man: DataFrame, junction: DataFrame, pool: DataFrame, retain: int, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Manifests to delete, and chunks to delete once their rows have gone."""
    gone = prunable(man, retain)
    live = junction.join(gone.select(*OWNER, "seq"), [*OWNER, "seq"], "left_anti")
    return gone, collectable(pool, live, now)


def dangling(junction: DataFrame, man: DataFrame) -> DataFrame:
    """Junction rows without a complete manifest."""
    return junction.join(man.where("complete").select(*OWNER, "seq"), [*OWNER, "seq"], "left_anti")


def dedup_ratio(junction: DataFrame, before: DataFrame) -> DataFrame:
    """``referenced, written``: positions of a batch, and its distinct hashes that the pool ``before`` lacks."""
    known = before.select("hash").distinct().withColumn("_known", F.lit(True))
    per = junction.groupBy("hash").agg(F.count("*").alias("_n")).join(known, "hash", "left")
    return per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("referenced"), F.count_if(F.col("_known").isNull()).alias("written"))


def merged_pools(a: DataFrame, b: DataFrame) -> DataFrame:
    """Left-biased union of two chunk maps; in either order the same where equal hashes hold equal data."""
    return a.unionByName(b.join(a.select("hash"), "hash", "left_anti").select(*a.columns))
