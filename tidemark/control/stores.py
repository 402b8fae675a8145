"""Stores on a commit log: versioned keys, checkpoints with cursors, and transaction history, each write one commit.

Every write takes an open :class:`~tidemark.control.commit.Transaction` or makes its own. What a write is refused for is found by one
plan over its batch, and raised before anything is committed.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checkpoint, cursors, history, temporal
from .commit import Log, Transaction, with_transaction
from .errors import raise_error

KEY = temporal.KEY
PUTS = "ns string, scope string, key string, value string, written_at timestamp, ord long"
MANIFESTS = "w string, net string, seq long, manifest_hash string, n_chunks long, bytes long, complete boolean, label string, created_at timestamp"
JUNCTION = "w string, net string, seq long, position int, hash string"
CHUNKS = "hash string, data binary, size_bytes int"
SAVES = "hash string, created_at timestamp"
SETS = "kind string, key string, value string, updated_at timestamp, ord long"


def _within(log: Log, tx: Transaction | None, work, retries: int = 3):
    return work(tx) if tx is not None else with_transaction(log, work, retries=retries)


class KvStore:
    """Versioned keys of one log."""

    def __init__(self, log: Log, table: str = "kv"):
        self.log, self.table = log, table

    def puts(self, tx: Transaction | None = None) -> DataFrame:
        return tx.read(self.table, PUTS) if tx is not None else self.log.read(self.table, PUTS)

    def put(self, batch: DataFrame, at: datetime, tx: Transaction | None = None) -> None:
        """All of ``batch`` (``KEY, value, ord`` and perhaps ``expected``) at one instant, or nothing.

        Raises VALIDATION_FAILED, TRANSACTION_KEY_REUSE, VERSION_CONFLICT (with ``expected`` and ``actual``) or CLOCK_REGRESSION.
        """
        if "expected" not in batch.columns:
            batch = batch.withColumn("expected", F.lit(None).cast("long"))

        def work(t: Transaction) -> None:
            bad = temporal.invalid_rows(batch)
            now = temporal.current(self.puts(t).join(batch.select(*KEY).distinct(), KEY, "left_semi")).select(*KEY, F.col("version").alias("actual"), "updated_at")
            seen = batch.join(now, KEY, "left")
            refused = F.when(F.col("expected") != F.coalesce("actual", F.lit(0)), F.lit("VERSION_CONFLICT")).when(F.col("updated_at") >= F.lit(at), F.lit("CLOCK_REGRESSION"))
            example = F.struct(*KEY, "expected", "actual")
            rows = seen.select(refused.alias("code"), example.alias("x")).where("code is not null")
            twice = batch.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("TRANSACTION_KEY_REUSE").alias("code"), F.struct(*KEY, *[F.lit(None).cast("long").alias(c) for c in ("expected", "actual")]).alias("x"))
            wrong = bad.select(F.lit("VALIDATION_FAILED").alias("code"), F.struct(*KEY, *[F.lit(None).cast("long").alias(c) for c in ("expected", "actual")]).alias("x"))
            first = wrong.unionByName(twice).unionByName(rows).groupBy("code").agg(F.min("x").alias("x")).collect()
            for code in ("VALIDATION_FAILED", "TRANSACTION_KEY_REUSE", "VERSION_CONFLICT", "CLOCK_REGRESSION"):
                for r in first:
                    if r.code == code:
                        raise_error(code, f"{r.x.ns}/{r.x.scope}/{r.x.key}", expected=r.x.expected, actual=r.x.actual)
            t.append(self.table, batch.select(*KEY, "value", F.lit(at).alias("written_at"), F.col("ord").cast("long").alias("ord")))

        _within(self.log, tx, work)

    def current(self) -> DataFrame:
        return temporal.current(self.puts())


class CheckpointStore:
    """Content-addressed checkpoints and cursors of one log."""

    def __init__(self, log: Log):
        self.log = log

    def tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Manifests, junction and pool; a chunk's clock is its last save."""
        clock = self.log.read("saves", SAVES).groupBy("hash").agg(F.max("created_at").alias("created_at"))
        pool = self.log.read("chunks", CHUNKS).join(clock, "hash")
        return self.log.read("manifests", MANIFESTS), self.log.read("junction", JUNCTION), pool

    def save(
        self, payloads: DataFrame, at: datetime, order: str = "ord", chunk_size: int = checkpoint.DEFAULT_CHUNK, label: str | None = None, tx: Transaction | None = None
    ) -> DataFrame:
        """One checkpoint for each of ``payloads`` (``w, net, data`` and ``order``): the new manifests.

        Numbers go on without a gap from each owner's last. Chunks that are stored already aren't stored again, but their clock is
        refreshed. Everything becomes visible in one commit.
        """
        checkpoint.check_options(chunk_size, label)

        def work(t: Transaction) -> DataFrame:
            read = lambda name, schema: self.log.spark.read.schema(schema).parquet(self.log.files.at(name))
            numbered = checkpoint.allocate(payloads.select("w", "net", "data", order), t.read("manifests", MANIFESTS), order)
            chunks = checkpoint.split(numbered, chunk_size)
            junction = read(t.append("junction", chunks.select("w", "net", "seq", "position", "hash")), JUNCTION)
            fresh = chunks.select("hash", "data", "size_bytes").join(t.read("chunks", CHUNKS).select("hash"), "hash", "left_anti")
            t.append("chunks", fresh.groupBy("hash").agg(F.any_value("data").alias("data"), F.any_value("size_bytes").alias("size_bytes")))
            t.append("saves", junction.select("hash").distinct().withColumn("created_at", F.lit(at)))
            sizes = numbered.select("w", "net", "seq", F.octet_length("data").cast("long").alias("bytes"))
            man = checkpoint.manifests(numbered, junction).join(sizes, ["w", "net", "seq"])
            man = man.select("w", "net", "seq", "manifest_hash", "n_chunks", "bytes", F.lit(True).alias("complete"), F.lit(label).cast("string").alias("label"), F.lit(at).alias("created_at"))
            return read(t.append("manifests", man), MANIFESTS)

        return _within(self.log, tx, work)

    def save_and_advance(self, payloads: DataFrame, sets: DataFrame, at: datetime, order: str = "ord", **options) -> DataFrame:
        """Checkpoints and the cursors that say so (``kind, key, value, updated_at, ord``) in one commit: no cursor is ever ahead."""

        def work(t: Transaction) -> DataFrame:
            saved = self.save(payloads, at, order, tx=t, **options)
            if sets.where("value is null").limit(1).count():
                cursors.check_value(None)
            t.append("cursors", sets.select("kind", "key", "value", "updated_at", "ord"))
            return saved

        return _within(self.log, None, work)

    def cursors(self) -> DataFrame:
        return cursors.last_write_wins(self.log.read("cursors", SETS))

    def load(self, seq: int | None = None) -> DataFrame:
        """Payloads of a number, or of each owner's latest; ``problem`` where one doesn't load."""
        man, junction, pool = self.tables()
        return checkpoint.reassemble(checkpoint.load(man, seq), junction, pool)

    def prune(self, retain: int, now: datetime) -> int:
        """Keeps each owner's newest ``retain`` complete checkpoints and collects unlisted chunks past their grace time; manifests gone."""
        man, junction, pool = self.tables()

        def work(t: Transaction) -> int:
            gone, dead = checkpoint.prune_and_collect(man, junction, pool, retain, now)
            owner = ["w", "net", "seq"]
            t.replace("manifests", man.join(gone.select(*owner), owner, "left_anti"))
            t.replace("junction", junction.join(gone.select(*owner), owner, "left_anti"))
            t.replace("chunks", self.log.read("chunks", CHUNKS).join(dead.select("hash"), "hash", "left_anti"))
            t.replace("saves", self.log.read("saves", SAVES).join(dead.select("hash"), "hash", "left_anti"))
            return gone.count()

        return _within(self.log, None, work, retries=0)


class HistoryStore:
    """Lifecycle commands of one log; entries are their replay."""

    COMMANDS = "wallet_id string, ord long, kind string, hash string, identifiers array<string>, protocol_version long, status string, timestamp string, fees string"

    def __init__(self, log: Log):
        self.log = log

    def _got(self, kind: str, entries: DataFrame, tx: Transaction | None) -> None:
        names = [c.split()[0] for c in self.COMMANDS.split(", ")]

        def work(t: Transaction) -> None:
            # later commits come later; within one, ``ord`` decides
            rows = entries.withColumns({"kind": F.lit(kind), "ord": F.lit((t.base + 1) << 40) + F.col("ord").cast("long")})
            missing = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in self.COMMANDS.split(", ") if c.split()[0] not in rows.columns}
            t.append("history", rows.withColumns(missing).select(*names))

        _within(self.log, tx, work)

    def got_pending(self, entries: DataFrame, tx: Transaction | None = None) -> None:
        """Entries (``wallet_id, hash, identifiers, ord`` and facts) seen as pending."""
        self._got("pending", entries, tx)

    def got_finalized(self, entries: DataFrame, tx: Transaction | None = None) -> None:
        self._got("finalized", entries, tx)

    def got_rejected(self, entries: DataFrame, tx: Transaction | None = None) -> None:
        self._got("rejected", entries, tx)

    def entries(self) -> DataFrame:
        return history.replay(self.log.read("history", self.COMMANDS))
