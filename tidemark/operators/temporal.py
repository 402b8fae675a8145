"""Versioned key-value state as views of one append-only event log.

An event is ``ns, scope, key, value, written_at, ord``. Versions, intervals, current state and every point-in-time read
derive from the log by windows and aggregates. Windows run within a key and a time bucket, with bucket totals carried
across: a key that holds a third of all rows is still spread over many tasks.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..control.errors import raise_error
from ..functions.values import MAX_DEPTH, nesting, safe_text
from .fold import ordered_fold

KEY = ["ns", "scope", "key"]


def versions(puts: DataFrame, bucket: str = "DAY", with_last: bool = False) -> DataFrame:
    """``KEY, value, version, valid_from, valid_to``: versions 1, 2, ... by time; the live one has no ``valid_to``.

    ``with_last`` adds ``last_version``, the key's greatest, from the bucket totals.
    """
    log = puts.withColumn("_b", F.date_trunc(bucket, "written_at"))
    sums = log.groupBy(*KEY, "_b").agg(F.count("*").alias("_n"), F.min("written_at").alias("_first"))
    across = Window.partitionBy(*KEY).orderBy("_b")
    sums = sums.select(
        *KEY, "_b", F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.lead("_first").over(across).alias("_next"),
        *([F.sum("_n").over(Window.partitionBy(*KEY)).alias("last_version")] if with_last else []),
    )
    within = Window.partitionBy(*KEY, "_b").orderBy("written_at", "ord")
    ranked = log.withColumn("_rn", F.row_number().over(within)).withColumn("_lead", F.lead("written_at").over(within))
    out = ranked.join(sums, [*KEY, "_b"])
    return out.select(
        *KEY, "value", (F.col("_base") + F.col("_rn")).cast("long").alias("version"), F.col("written_at").alias("valid_from"), F.coalesce("_lead", "_next").alias("valid_to"),
        *(["last_version"] if with_last else []),
    )


def strict(puts: DataFrame, bucket: int = 1_000_000) -> DataFrame:
    """The log without writes that aren't later than all before them in log order: no interval of what is left is empty."""
    log = puts.withColumn("_b", F.floor(F.col("ord") / bucket))
    tops = log.groupBy(*KEY, "_b").agg(F.max("written_at").alias("_top"))
    before = Window.partitionBy(*KEY).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*KEY, "_b", F.max("_top").over(before).alias("_in"))
    within = Window.partitionBy(*KEY, "_b").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    seen = log.withColumn("_own", F.max("written_at").over(within)).join(tops, [*KEY, "_b"])
    latest = F.greatest("_own", "_in")
    return seen.where(latest.isNull() | (F.col("written_at") > latest)).select(*puts.columns)


def history(vers: DataFrame) -> DataFrame:
    """Superseded versions with their closed-open intervals."""
    return vers.where("valid_to is not null")


def current(puts: DataFrame) -> DataFrame:
    """Live value and version of every key, by aggregates that combine before the shuffle."""
    at = F.struct("written_at", "ord")
    return puts.groupBy(*KEY).agg(F.max_by("value", at).alias("value"), F.count("*").alias("version"), F.max("written_at").alias("updated_at"))


def get(puts: DataFrame, ns: str, scope: str, key: str) -> DataFrame:
    check_key(ns, scope, key)
    return current(puts.where((F.col("ns") == ns) & (F.col("scope") == scope) & (F.col("key") == key)))


def check_key(ns: str, scope: str, key: str) -> None:
    for name, text, most in (("ns", ns, 63), ("scope", scope, 63), ("key", key, None)):
        if not isinstance(text, str) or not text or (most and len(text) > most) or "\x00" in text or any("\ud800" <= c <= "\udfff" for c in text):
            raise_error("VALIDATION_FAILED", f"{name} is not a valid name")


def get_at(vers: DataFrame, *, version: int | None = None, at: datetime | None = None) -> DataFrame:
    """Every key as of a version or an instant; absent before its first write. Exactly one address is given."""
    if (version is None) == (at is None):
        raise_error("VALIDATION_FAILED", "give a version or an instant")
    if version is not None:
        if isinstance(version, bool) or not isinstance(version, int) or not 1 <= version < 1 << 63:
            raise_error("VALIDATION_FAILED", f"not a version: {version!r}")
        return vers.where(F.col("version") == version)
    if not isinstance(at, datetime):
        raise_error("VALIDATION_FAILED", f"not an instant: {at!r}")
    return vers.where((F.col("valid_from") <= F.lit(at)) & (F.col("valid_to").isNull() | (F.lit(at) < F.col("valid_to"))))


def as_of_log(puts: DataFrame, at: datetime) -> DataFrame:
    """State of all keys at an instant straight from the log: the pushed-down filter, then one combined aggregate."""
    return current(puts.where(F.col("written_at") <= F.lit(at)))


def as_of_join(puts: DataFrame, probes: DataFrame, at: str = "at", bucket: str = "DAY") -> DataFrame:
    """Each probe (``KEY`` and ``at``) with the value then: ``value`` and ``written_at``, null before the first write.

    Writes and probes are merged by time within a key's bucket; the last write before the bucket is carried in.
    """
    extra = [c for c in probes.columns if c not in (*KEY, at)]
    w = puts.select(*KEY, F.col("written_at").alias("_t"), F.lit(0).alias("_p"), F.struct("written_at", "ord", "value").alias("_w"), *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra])
    p = probes.select(*KEY, F.col(at).alias("_t"), F.lit(1).alias("_p"), F.lit(None).cast(w.schema["_w"].dataType).alias("_w"), *extra)
    both = w.unionByName(p).withColumn("_b", F.date_trunc(bucket, "_t"))
    last = both.groupBy(*KEY, "_b").agg(F.max("_w").alias("_m"))
    carried = last.select(*KEY, "_b", F.max("_m").over(Window.partitionBy(*KEY).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_in"))
    within = Window.partitionBy(*KEY, "_b").orderBy("_t", "_p", "_w").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_own", F.last("_w", ignorenulls=True).over(within)).where("_p = 1")
    found = seen.join(carried, [*KEY, "_b"]).withColumn("_f", F.coalesce("_own", "_in"))
    return found.select(*KEY, F.col("_t").alias(at), *extra, F.col("_f.value").alias("value"), F.col("_f.written_at").alias("written_at"))


def list_keys(puts: DataFrame, ns: str, scope: str, prefix: str = "") -> DataFrame:
    """Keys with a literal prefix, in binary order."""
    rows = puts.where((F.col("ns") == ns) & (F.col("scope") == scope) & F.startswith("key", F.lit(prefix)))
    return rows.select("key").distinct().orderBy("key")


def iterate_keys(puts: DataFrame, ns: str, scope: str, prefix: str = "", batch: int = 256, cancelled=lambda: False):
    """Key batches through a cursor that fetches one partition ahead; stops when ``cancelled()``."""
    out: list[str] = []
    for row in list_keys(puts, ns, scope, prefix).toLocalIterator(prefetchPartitions=True):
        if cancelled():
            return
        out.append(row.key)
        if len(out) == batch:
            yield out
            out = []
    if out:
        yield out


def create_only(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """First put of each key that doesn't exist yet: inserts at version 1; the other rows are :func:`create_conflicts`."""
    first = batch.join(existing.select(*KEY).distinct(), KEY, "left_anti").groupBy(*KEY).agg(F.min(F.struct("written_at", "ord", "value")).alias("f"))
    return first.select(*KEY, "f.value", "f.written_at", "f.ord", F.lit(1).cast("long").alias("version"))


def create_conflicts(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of a create-only batch that are refused: ``KEY, ord, expected`` (0) and ``actual``, the version that they met."""
    there = existing.groupBy(*KEY).agg(F.count("*").alias("_n"))
    first = batch.groupBy(*KEY).agg(F.min(F.struct("written_at", "ord")).alias("_f"))
    seen = batch.join(there, KEY, "left").join(first, KEY)
    won = F.col("_n").isNull() & (F.struct("written_at", "ord") == F.col("_f"))
    return seen.where(~won).select(*KEY, "ord", F.lit(0).cast("long").alias("expected"), F.coalesce("_n", F.lit(1)).cast("long").alias("actual"))


def cas_replay(ops: DataFrame) -> DataFrame:
    """Outcome of each put with ``expected`` (null: unconditional, 0: create only, n: compare and swap), in order.

    ``ord, ok, version`` (after the put) and ``actual`` (the version a conflict met; null if the key was never written).
    """

    def step(state, row):
        now = state["v"]
        ok = row.expected is None or row.expected != row.expected or int(row.expected) == now
        state["v"] += ok
        return [(row.ns, row.scope, row.key, row.ord, ok, state["v"], None if ok or not now else str(now))]

    # numbers that may be null go as text: pandas would make doubles of them
    rows = ops.select(*KEY, "ord", F.col("expected").cast("string").alias("expected"), "written_at")
    schema = "ns string, scope string, key string, ord long, ok boolean, version long, actual string"
    out = ordered_fold(rows, KEY, ["written_at", "ord"], lambda: {"v": 0}, step, schema)
    return out.withColumn("actual", F.col("actual").cast("long"))


def reused_keys(puts: DataFrame, tx: str = "txid") -> DataFrame:
    """Keys written more than once in one transaction."""
    return puts.groupBy(tx, *KEY).agg(F.count("*").alias("writes")).where("writes > 1")


def clock_regressions(puts: DataFrame) -> DataFrame:
    """Writes, in log order, not later than the write before them."""
    before = F.lag("written_at").over(Window.partitionBy(*KEY).orderBy("ord"))
    return puts.withColumn("before", before).where("before >= written_at")


def invalid_rows(puts: DataFrame) -> DataFrame:
    """Events whose names or values break the rules."""
    return puts.where(~safe_text(F.col("ns"), 1, 63) | ~safe_text(F.col("scope"), 1, 63) | ~safe_text(F.col("key")) | F.col("value").isNull() | (nesting(F.col("value")) > MAX_DEPTH))


def overlaps(vers: DataFrame) -> DataFrame:
    """Intervals that begin before an earlier one of their key has ended: a running maximum, not a self-join."""
    w = Window.partitionBy(*KEY).orderBy("valid_from", "version").rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce("valid_to", F.lit("9999-12-31").cast("timestamp"))
    return vers.withColumn("reach", F.max(end).over(w)).where("valid_from < reach")


def version_summary(vers: DataFrame) -> DataFrame:
    """Per key: least, greatest, count and distinct count of versions, and whether they run 1, 2, ... without a gap."""
    s = vers.groupBy(*KEY).agg(F.min("version").alias("low"), F.max("version").alias("high"), F.count("*").alias("n"), F.count_distinct("version").alias("distinct_n"))
    return s.withColumn("gapless", (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("n") == F.col("distinct_n")))


def gaps_in_time(vers: DataFrame) -> DataFrame:
    """Versions whose interval doesn't end where the next begins.

    Of versions that share a number the later one follows; rows that share the beginning, too, are all followed by what comes after them.
    """
    at = F.struct("version", "valid_from")
    lead = F.lead(at).over(Window.partitionBy(*KEY).orderBy("version", "valid_from"))
    ahead = vers.withColumn("_ahead", F.when(lead != at, lead["valid_from"]))
    following = F.max("_ahead").over(Window.partitionBy(*KEY, "version", "valid_from"))
    return ahead.withColumn("next_from", following).where("next_from is not null and (valid_to is null or valid_to <> next_from)").drop("_ahead")


def prune_prefix(vers: DataFrame, n: int) -> DataFrame:
    """Versions left when each key's ``n`` oldest go; a key of ``n`` versions or fewer, whose live one would go, is left whole.

    With ``last_version`` in ``vers`` (see :func:`versions`) this is a filter.
    """
    if isinstance(n, bool) or n < 0:
        raise_error("VALIDATION_FAILED", "n counts versions")
    if "last_version" in vers.columns:
        return vers.where((F.col("last_version") <= n) | (F.col("version") > n)).drop("last_version")
    sizes = vers.groupBy(*KEY).agg(F.max("version").alias("_high"))
    return vers.join(sizes, KEY).where((F.col("_high") <= n) | (F.col("version") > n)).drop("_high")


def lookup(kept: DataFrame, probes: DataFrame, at: datetime) -> DataFrame:
    """Each probed key at an instant: found with its value, absent, or unavailable with the floor where history was pruned."""
    floors = kept.groupBy(*KEY).agg(F.min("version").alias("floor_version"), F.min("valid_from").alias("floor_at"))
    hit = get_at(kept, at=at).select(*KEY, "value", "version")
    out = probes.select(*KEY).distinct().join(floors, KEY, "left").join(hit, KEY, "left")
    state = F.when(F.col("version").isNotNull(), "found").when((F.col("floor_version") > 1) & (F.lit(at) < F.col("floor_at")), "unavailable").otherwise("absent")
    return out.select(*KEY, state.alias("state"), "value", "version", F.when(state == "unavailable", F.col("floor_version")).alias("floor"))
