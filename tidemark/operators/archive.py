"""Fork-aware block archive: first-write-wins blocks, transactions and blobs; canonical flips; ranges; audits; decoding."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..control.errors import raise_error
from ..control.files import Files, shared_dir, write_once
from .fold import ordered_fold

BLOCK = ["net", "height", "block_hash"]
BUCKET = 1_000_000
#: Allowed values (fixed values).
ROLES = ("block_header", "block_body", "tx_raw", "bridge_observation", "verifier_key", "proof")
TX_KINDS, STATUSES = ("regular", "system"), ("seen", "canonical", "orphaned", "pruned")


def bucket_of(height: Column, size: int = BUCKET) -> Column:
    """The partition column of a height."""
    return F.floor(height / size).cast("long")


def height_range(df: DataFrame, low: int, high: int, size: int = BUCKET) -> DataFrame:
    """An inclusive range, with the bounds on the bucket that let Spark prune partitions."""
    rows = df.where(F.col("height").between(low, high))
    return rows.where(F.col("bucket").between(low // size, high // size)) if "bucket" in df.columns else rows


def written(df: DataFrame, files: Files, name: str) -> DataFrame:
    """``df`` written once and read from there."""
    write_once(df, files.at(name))
    return df.sparkSession.read.schema(df.schema).parquet(files.at(name))


def first_wins(batch: DataFrame, key: list[str], order: list[str], stored: DataFrame | None = None) -> DataFrame:
    """Rows of a batch that a first-write-wins insert keeps: the first of each key, unless it is stored."""
    fresh = batch.join(stored.select(*key), key, "left_anti") if stored is not None else batch
    others = [c for c in batch.columns if c not in key]
    if others == order and len(order) == 1:  # a hash aggregate, which combines before the shuffle without sorting
        return fresh.groupBy(*key).agg(F.min(order[0]).alias(order[0]))
    first = fresh.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r"))
    return first.select(*key, *[F.col(f"r.{c}").alias(c) for c in others])


def put_blobs(batch: DataFrame, blobs: DataFrame | None = None, roles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New blobs (``hash, data, size_bytes``) and new roles of ``data, role, ord`` rows."""
    hashed = batch.withColumn("hash", F.sha2("data", 256)).withColumn("size_bytes", F.octet_length("data"))
    new = first_wins(hashed.select("hash", "data", "size_bytes", "ord"), ["hash"], ["ord"], blobs).drop("ord")
    wanted = hashed.select(F.col("hash").alias("blob_hash"), "role").distinct()
    return new, wanted.join(roles, ["blob_hash", "role"], "left_anti") if roles is not None else wanted


def put_transactions(batch: DataFrame, order: list[str], stored: DataFrame | None = None) -> DataFrame:
    """Transactions that inserts in order keep: a row goes if its hash or its position is already in its block.

    A row that loses by one key doesn't hold the other, so a block's rows are folded in order, after those ``stored`` in the
    batch's blocks.
    """
    names = batch.columns

    def step(state, row):
        if row.tx_hash in state["hashes"] or row.position in state["positions"]:
            return []
        state["hashes"].add(row.tx_hash)
        state["positions"].add(row.position)
        return [] if row.is_stored else [tuple(row)[:-1]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
    rows = batch.select(*names).withColumn("is_stored", F.lit(False))
    if stored is not None:
        held = stored.join(batch.select(*BLOCK).distinct(), BLOCK, "left_semi").select(*names).withColumn("is_stored", F.lit(True))
        rows = held.unionByName(rows)
    return ordered_fold(rows.withColumn("is_new", ~F.col("is_stored")), BLOCK, ["is_new", *order], lambda: {"hashes": set(), "positions": set()}, step, schema, drop=["is_new"])


def slice_of(df: DataFrame, k: int, n: int) -> DataFrame:
    """The rows of the ``k``-th of ``n`` slices; all rows of a block are in one."""
    return df if n == 1 else df.where(F.pmod(F.xxhash64(*BLOCK), F.lit(n)) == k)


def put_bundle(tx, blocks: DataFrame, transactions: DataFrame, observations: DataFrame, order: str = "ord", slice_rows: int = 1 << 23) -> None:
    """All three in one commit of a :class:`~tidemark.control.commit.Transaction`; a retry of the same bundle adds nothing.

    Each insert is first-write-wins against what is stored and within the batch, in ``order``: blocks by block, transactions by
    hash and by position, observations by index. Every key lies in one block, so a bundle of over ``slice_rows`` rows of a table is
    staged in slices of its blocks, and what a slice has shuffled goes before the next. The frames are read once a slice.
    """
    n = max(1, -(-max(x.count() for x in (blocks, transactions, observations)) // slice_rows))
    for k in range(n):
        new = {name: slice_of(x, k, n) for name, x in (("blocks", blocks), ("transactions", transactions), ("observations", observations))}
        held = {name: slice_of(tx.read(name, x.schema), k, n) for name, x in new.items()}
        tx.append("blocks", first_wins(new["blocks"], BLOCK, [order], held["blocks"]).select(*blocks.columns))
        # a row with hash and position of one before it never stays: copies needn't reach the fold
        once = first_wins(new["transactions"], [*BLOCK, "tx_hash", "position"], [order]).select(*transactions.columns)
        tx.append("transactions", put_transactions(once, [order], held["transactions"]))
        seen = first_wins(new["observations"], [*BLOCK, "observation_index"], [order], held["observations"])
        tx.append("observations", seen.select(*observations.columns).repartition(*BLOCK).sortWithinPartitions(*BLOCK))


def verifier_keys(seen: DataFrame) -> DataFrame:
    """Least first-seen height of each observed key; missing addresses are equal."""
    return seen.groupBy("vk_hash", "net", "scope", "contract_address", "tag").agg(F.min("first_seen_height").alias("first_seen_height"))


def judged_flips(blocks: DataFrame, flips: DataFrame) -> DataFrame:
    """Flips (``net, height, block_hash, finalized, ord``) with ``refused``: null, or why the archive doesn't take them.

    ``unknown``: there is no such block. ``displaces``: another block of the height is final. ``unfinalizes``: it would take back the
    block's own finality. The first finalising flip of a height settles it, so no replay is needed to tell.
    """
    known = flips.join(blocks.select(*BLOCK).distinct().withColumn("_known", F.lit(True)), BLOCK, "left")
    final = known.where("_known and finalized").groupBy("net", "height").agg(F.min_by("block_hash", "ord").alias("_winner"), F.min("ord").alias("_at"))
    later = F.col("ord") > F.col("_at")
    refused = (
        F.when(F.col("_known").isNull(), "unknown")
        .when(later & (F.col("block_hash") != F.col("_winner")), "displaces")
        .when(later & ~F.col("finalized"), "unfinalizes")
    )
    return known.join(final, ["net", "height"], "left").select(*flips.columns, refused.alias("refused"))


def canonical(blocks: DataFrame, flips: DataFrame) -> DataFrame:
    """Blocks with ``is_canonical, status, finalized`` after all flips that aren't refused.

    The last flip of a height wins and orphans the winner before; a final block is never displaced. What is refused is in
    :func:`refused_flips`.
    """
    taken = judged_flips(blocks, flips).where("refused is null")
    winner = taken.groupBy("net", "height").agg(F.max_by("block_hash", "ord").alias("winner"), F.max(F.coalesce("finalized", F.lit(False))).alias("is_final"))
    flipped = taken.select(*BLOCK, F.lit(True).alias("flipped")).distinct()
    out = blocks.drop("is_canonical", "status", "finalized").join(winner, ["net", "height"], "left").join(flipped, BLOCK, "left")
    is_canonical = F.coalesce(F.col("winner") == F.col("block_hash"), F.lit(False))
    status = F.when(is_canonical, "canonical").when(F.col("flipped"), "orphaned").otherwise("seen")
    return out.select(
        *[c for c in blocks.columns if c not in ("is_canonical", "status", "finalized")], is_canonical.alias("is_canonical"), status.alias("status"),
        (is_canonical & F.coalesce("is_final", F.lit(False))).alias("finalized"),
    )


def canonical_chain(blocks: DataFrame, flips: DataFrame, near_rows: int = 1 << 18, slice_rows: int = 1 << 23) -> DataFrame:
    """Of ``blocks`` those that :func:`canonical` marks, as they are, without the state of the others. Stored in the shared folder.

    A height's winner is its first finalising flip, else its last, of the flips that name a block. So its flips are reduced to one by
    their ``ord``, which combines before the shuffle, and only the block that this one names is looked up. Heights without it are
    judged again over the flips that name a block. Up to ``near_rows`` heights are broadcast and no block is shuffled; what has to be
    shuffled is so in slices of about ``slice_rows``, and goes before the next. If flips of a height share the deciding ``ord``, the
    least hash of a block wins.
    """
    spark, height, schema = blocks.sparkSession, ["net", "height"], blocks.schema
    files = Files(spark, f"{shared_dir(spark)}/chain-{uuid.uuid4().hex}")
    flips = flips.select(*BLOCK, "finalized", "ord")

    def near(df, rows):
        return F.broadcast(df) if rows <= near_rows else df

    def decided(flips):
        """The ``ord`` that decides each height, of ``n`` flips."""
        first = F.min(F.when(F.col("finalized"), F.col("ord")))
        some = flips.where("net is not null and height is not null and ord is not null").groupBy(*height)
        return some.agg(F.coalesce(first, F.max("ord")).alias("ord"), first.isNotNull().alias("is_final"), F.count("*").alias("n"))

    def winners(blocks, flips, last, n, name):
        deciding = flips.join(near(last.drop("n"), n), [*height, "ord"]).where("finalized or not is_final")
        named = written(deciding.select(*BLOCK).distinct(), files, "named")
        found = written(blocks.join(near(named, n), BLOCK).select(*schema.names), files, "found")
        out = written(found.join(found.groupBy(*height).agg(F.min("block_hash").alias("block_hash")), BLOCK, "left_semi"), files, name)
        files.delete("named"), files.delete("found")
        return out

    last = written(decided(flips), files, "last")
    heights, rows = last.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    slices = -(-max(rows, blocks.count()) // slice_rows) if heights > near_rows else 1
    names = []
    for k in range(slices):
        b, f, now = (df if slices == 1 else df.where(F.pmod(F.xxhash64(*height), F.lit(slices)) == k) for df in (blocks, flips, last))
        found = winners(b, f, now, heights, f"chain-{k}")
        names.append(f"chain-{k}")
        rest = written(now.join(found, height, "left_anti"), files, "rest")
        if lacking := rest.count():
            b, f = (df.join(near(rest.select(*height), lacking), height, "left_semi") for df in (b, f))
            parts = -(-max(rows, blocks.count()) // (slices * slice_rows))
            for i in range(parts):
                written(slice_of(f, i, parts).join(slice_of(b, i, parts).select(*BLOCK), BLOCK, "left_semi"), files, f"known-{i}")
            known = spark.read.schema(flips.schema).parquet(*[files.at(f"known-{i}") for i in range(parts)])
            winners(b, known, written(decided(known), files, "again"), lacking, f"again-{k}")
            names.append(f"again-{k}")
            for name in ("again", *[f"known-{i}" for i in range(parts)]):
                files.delete(name)
        files.delete("rest")
    files.delete("last")
    return spark.read.schema(schema).parquet(*[files.at(name) for name in names])


def refused_flips(blocks: DataFrame, flips: DataFrame) -> DataFrame:
    return judged_flips(blocks, flips).where("refused is not null")


def blocks_at(blocks: DataFrame, net: str, height: int) -> DataFrame:
    return height_range(blocks.where(F.col("net") == net), height, height).orderBy("block_hash")


def canonical_at(blocks: DataFrame, net: str, height: int) -> DataFrame:
    return blocks_at(blocks.where("is_canonical"), net, height)


def transactions_by_hash(txs: DataFrame, net: str, tx_hash: str) -> DataFrame:
    return txs.where((F.col("net") == net) & (F.col("tx_hash") == tx_hash)).orderBy("block_hash")


def transactions_of(txs: DataFrame, net: str, height: int, block_hash: str) -> DataFrame:
    return height_range(txs.where((F.col("net") == net) & (F.col("block_hash") == block_hash)), height, height).orderBy("position")


def canonical_range(blocks: DataFrame, net: str, low: int, high: int) -> DataFrame:
    return height_range(blocks.where((F.col("net") == net) & F.col("is_canonical")), low, high).orderBy("height")


def checked_blobs(wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    """``hash, problem``: blob_missing, blob_hash or null for each wanted hash; the data is rehashed before the join."""
    state = blobs.select("hash", (F.sha2("data", 256) == F.col("hash")).alias("intact"))
    out = wanted.select("hash").distinct().join(state, "hash", "left")
    return out.select("hash", F.when(F.col("intact").isNull(), "blob_missing").when(~F.col("intact"), "blob_hash").alias("problem"))


def missing_roles(uses: DataFrame, roles: DataFrame) -> DataFrame:
    """Uses (``blob_hash, role``) of blobs that lack the role."""
    return uses.select("blob_hash", "role").distinct().join(roles, ["blob_hash", "role"], "left_anti")


def blocked_removals(removals: DataFrame, uses: DataFrame) -> DataFrame:
    """Role removals that are refused because the role is in use; a proof never is."""
    return removals.where("role <> 'proof'").join(uses.select("blob_hash", "role"), ["blob_hash", "role"], "left_semi")


def several_canonical(blocks: DataFrame) -> DataFrame:
    return blocks.where("is_canonical").groupBy("net", "height").agg(F.count("*").alias("n")).where("n > 1")


def inconsistent_status(blocks: DataFrame) -> DataFrame:
    return blocks.where(((F.col("status") == "canonical") != F.col("is_canonical")) | (F.col("finalized") & ~F.col("is_canonical")))


def unfinalised(revisions: DataFrame) -> DataFrame:
    """Revisions (``BLOCK, finalized, ord``) that take back a finalisation."""
    return revisions.withColumn("was", F.lag("finalized").over(Window.partitionBy(*BLOCK).orderBy("ord"))).where("was and not finalized")


def orphan_rows(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    return rows.join(blocks.select(*BLOCK), BLOCK, "left_anti")


def span(df: DataFrame, size: int = BUCKET) -> DataFrame:
    """Rows, least and greatest height of each bucket: what a repartition job has to cover."""
    return df.groupBy("net", bucket_of(F.col("height"), size).alias("bucket")).agg(F.count("*").alias("n"), F.min("height").alias("low"), F.max("height").alias("high"))


def write_partitioned(df: DataFrame, path: str, size: int = BUCKET) -> None:
    """Writes by net and height bucket, rows sorted by height; running it again gives the same partitions."""
    spread = df.withColumn("bucket", bucket_of(F.col("height"), size)).repartition("net", "bucket").sortWithinPartitions("net", "bucket", "height")
    spread.write.mode("overwrite").partitionBy("net", "bucket").parquet(path)


def sync_range(cursor: int | None, tip: int, max_blocks: int) -> range:
    """Heights to fetch: after the cursor up to the finalised tip, at most ``max_blocks``."""
    if max_blocks < 1:
        raise_error("VALIDATION_FAILED", "max_blocks")
    first = 0 if cursor is None else cursor + 1
    return range(first, min(tip, first + max_blocks - 1) + 1)


def no_prefix(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "^0[xX]", ""))


def block_records(node: DataFrame, net: str) -> DataFrame:
    """Block rows from node blocks (``hash, header, extrinsics``): header and body hashed in a canonical JSON form."""
    h = F.col("header")
    digits = no_prefix(h["number"])
    height = F.when(digits.rlike("^[0-9a-f]{1,15}$"), F.conv(digits, 16, 10).cast("long"))
    header = F.to_json(F.struct(h["digest"].alias("digest"), h["extrinsicsRoot"].alias("extrinsicsRoot"), h["number"].alias("number"), h["parentHash"].alias("parentHash"), h["stateRoot"].alias("stateRoot")))
    return node.select(
        F.lit(net).alias("net"), height.alias("height"), no_prefix(F.col("hash")).alias("block_hash"), no_prefix(h["parentHash"]).alias("parent_hash"),
        no_prefix(h["stateRoot"]).alias("state_root"), no_prefix(h["extrinsicsRoot"]).alias("extrinsics_root"),
        F.sha2(header, 256).alias("header_blob_hash"), F.sha2(F.to_json("extrinsics"), 256).alias("body_blob_hash"), F.col("extrinsics"),
    )


def transaction_records(blocks: DataFrame, indexed: DataFrame, system_tag: str) -> DataFrame:
    """Transactions of indexer blocks (``height, hash, transactions``) joined to node blocks, with ``problem`` where they disagree.

    A block is met by height and hash, so forks don't disturb one another; without one the hashes disagree. A raw payload that starts
    with ``system_tag`` is a system transaction; any other must lie within one of the block's extrinsics, which are searched
    before the transactions become rows.
    """
    seen = indexed.select("height", no_prefix(F.col("hash")).alias("block_hash"), "transactions")
    both = seen.join(blocks.select("net", "height", "block_hash", "extrinsics"), ["height", "block_hash"], "left")

    def record(t: Column, position: Column) -> Column:
        raw = no_prefix(t["raw"])
        kind = F.when(F.startswith(raw, F.lit(system_tag.encode().hex())), "system").otherwise("regular")
        inside = F.exists("extrinsics", lambda e: F.contains(no_prefix(e), raw))
        problem = F.when(F.col("net").isNull(), "hash mismatch").when((kind == "regular") & ~inside, "not in block body")
        return F.struct(
            no_prefix(t["hash"]).alias("tx_hash"), position.cast("int").alias("position"), kind.alias("kind"), t["protocolVersion"].alias("protocol_version"), raw.alias("raw"), problem.alias("problem")
        )

    return both.select("net", "height", "block_hash", F.inline(F.transform("transactions", record))).select(
        "net", "tx_hash", "height", "block_hash", "position", "kind", "protocol_version", "raw", "problem"
    )


def parameter_changes(rows: DataFrame, value: str = "value", size: int = BUCKET) -> DataFrame:
    """Rows whose value differs from that of the height before; the first of a net counts as a change.

    Rows are compared within height buckets, with the last value of the bucket before carried in.
    """
    df = rows.withColumn("_b", bucket_of(F.col("height"), size))
    last = df.groupBy("net", "_b").agg(F.max_by(F.struct(F.col(value).alias("v")), "height").alias("_last"))
    carried = last.select("net", "_b", F.lag("_last").over(Window.partitionBy("net").orderBy("_b")).alias("_in"))
    before = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy("net", "_b").orderBy("height"))
    seen = df.withColumn("_own", before).join(carried, ["net", "_b"]).withColumn("_p", F.coalesce("_own", "_in"))
    return seen.where(F.col("_p").isNull() | ~F.col(value).eqNullSafe(F.col("_p.v"))).select(*rows.columns)


def tag_kind(raw: Column, system_tag: str, standard_tag: str) -> Column:
    """system, standard or null by the tag that raw bytes begin with."""
    head = lambda tag: F.substring(F.hex(raw), 1, len(tag) * 2) == tag.encode().hex().upper()
    return F.when(head(system_tag), "system").when(head(standard_tag), "standard")


#: Flattened record lists of a decoded transaction.
DECODED = (
    "tx_hash string, record string, section string, segment_id long, record_index long, owner string, token_type string, amount decimal(38,0), reference string, contract_address string"
)


def decode_transactions(txs: DataFrame, decoder) -> DataFrame:
    """Flattens what an injected ``decoder(bytes) -> dict`` makes of each raw transaction into rows of :data:`DECODED`.

    Outputs of an intent share one counter, guaranteed ones first.
    """
    import pandas as pd

    columns = [f.split()[0] for f in DECODED.replace("decimal(38,0)", "decimal").split(", ")]

    def flatten(key, tx):
        out = []

        def add(record, section, segment, index, owner=None, token=None, amount=None, reference=None, address=None):
            out.append((key, record, section, segment, index, owner, token, amount, reference, address))

        offers = [("guaranteed", None, tx.get("guaranteedOffer"))] + [("fallible", s, o) for s, o in tx.get("fallibleOffer") or []]
        for section, segment, offer in offers:
            for i, x in enumerate((offer or {}).get("outputs", [])):
                add("zswap_output", section, segment, i, reference=x["commitment"], address=x.get("contractAddress"))
            for i, x in enumerate((offer or {}).get("inputs", [])):
                add("zswap_input", section, segment, i, reference=x["nullifier"], address=x.get("contractAddress"))
        for segment, intent in tx.get("intents") or []:
            index = 0
            for section in ("guaranteed", "fallible"):
                for x in (intent.get(f"{section}UnshieldedOffer") or {}).get("outputs", []):
                    add("unshielded_output", section, segment, index, x["owner"], x["type"], int(x["value"]), intent.get("intentHash"))
                    index += 1
            dust = intent.get("dustActions") or {}
            for i, x in enumerate(dust.get("spends", [])):
                add("dust_spend", None, segment, i, amount=int(x["vFee"]), reference=x["oldNullifier"] + ":" + x["newCommitment"])
            for i, x in enumerate(dust.get("registrations", [])):
                add("dust_registration", None, segment, i, owner=x["nightKey"], amount=int(x["allowFeePayment"]), reference=x.get("dustAddress"))
        return out

    def run(batches):
        from decimal import Decimal

        for batch in batches:
            rows = [r for key, raw in zip(batch["tx_hash"], batch["raw"], strict=True) for r in flatten(key, decoder(bytes(raw)))]
            rows = [(*r[:7], None if r[7] is None else Decimal(r[7]), *r[8:]) for r in rows]
            yield pd.DataFrame(rows, columns=columns).astype({"segment_id": "Int64", "record_index": "Int64"})

    return txs.select("tx_hash", "raw").mapInPandas(run, DECODED)


def json_decoder(raw: bytes) -> dict:
    """A stand-in decoder for fixtures: the payload is JSON."""
    return json.loads(raw)


def ancestry(blocks: DataFrame, heads: DataFrame, depth: int) -> DataFrame:
    """Each of ``heads`` (``net, block_hash``) and up to ``depth`` ancestors along parent hashes: ``net, head, height, block_hash, steps``.

    By pointer doubling: after k rounds every block knows its 2**k-th ancestor, so the number of joins grows with the logarithm of the
    depth. Blocks are read once; rounds are stored in the shared folder, what a round has shuffled goes with its end and its pointers
    once the next are there.
    """
    spark = blocks.sparkSession
    files = Files(spark, f"{shared_dir(spark)}/ancestry-{uuid.uuid4().hex}")
    blocks = written(blocks.select("net", "block_hash", "parent_hash", "height"), files, "blocks")
    up = blocks.where("parent_hash is not null").select("net", "block_hash", F.col("parent_hash").alias("up"))
    found = written(heads.select("net", F.col("block_hash").alias("head"), "block_hash", F.lit(0).alias("steps")), files, "found-0")
    schema, folders, reach = found.schema, [files.at("found-0")], 1
    while reach <= depth:
        above = found.join(up, ["net", "block_hash"]).where(f"steps + {reach} <= {depth}").select("net", "head", F.col("up").alias("block_hash"), (F.col("steps") + reach).alias("steps"))
        written(above, files, f"found-{reach}")
        folders.append(files.at(f"found-{reach}"))
        found = spark.read.schema(schema).parquet(*folders)
        if 2 * reach <= depth:
            up = written(up.join(up.select("net", F.col("block_hash").alias("up"), F.col("up").alias("up_up")), ["net", "up"]).select("net", "block_hash", F.col("up_up").alias("up")), files, f"up-{2 * reach}")
        files.delete(f"up-{reach}")
        reach *= 2
    return found.join(blocks.select("net", "block_hash", "height"), ["net", "block_hash"]).select("net", "head", "height", "block_hash", "steps")


def rollover(landing: DataFrame, path: str, low: int, high: int, size: int = BUCKET) -> int:
    """Moves a landing table's rows of the buckets from ``low`` to ``high`` into the partitioned table at ``path``; their number.

    The bounds must be whole buckets that span all of the landing's heights. Only the buckets' partitions are written, rows already
    there included, so running it again changes nothing.
    """
    whole = all(isinstance(x, int) and not isinstance(x, bool) for x in (low, high))
    if not whole or not 0 <= low < high or low % size or high % size:
        raise_error("VALIDATION_FAILED", f"{low!r} to {high!r} aren't whole buckets of {size}")
    spark = landing.sparkSession
    least, most, n = landing.agg(F.min("height"), F.max("height"), F.count("*")).first()
    if n and (least < low or most >= high):
        raise_error("VALIDATION_FAILED", f"heights {least} to {most} aren't all from {low} to {high}", low=least, high=most)
    rows = landing.withColumn("bucket", bucket_of(F.col("height"), size))
    files = Files(spark, path)
    if any(name.startswith("net=") for name in files.names(".")):
        there = spark.read.schema(rows.schema).parquet(files.folder).where(F.col("bucket").between(low // size, (high - 1) // size))
        rows = there.select(*rows.columns).unionByName(rows).distinct()
    kept = f"{shared_dir(spark)}/rollover-{uuid.uuid4().hex}"
    rows.write.parquet(kept)  # a table isn't overwritten while it is read
    spread = spark.read.schema(rows.schema).parquet(kept).repartition("net", "bucket").sortWithinPartitions("net", "bucket", "height")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("net", "bucket").parquet(files.folder)
    return n
