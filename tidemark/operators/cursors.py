"""Durable progress cursors: last write wins, or heights that only go forward. Not event-time watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..control.errors import raise_error
from .fold import ordered_fold

CURSOR = ["kind", "key"]
ARCHIVE_KIND = "chain_archive"


def check_value(value) -> None:
    if value is None:
        raise_error("VALIDATION_FAILED", "a cursor's value can't be null")


def last_write_wins(sets: DataFrame) -> DataFrame:
    """``kind, key, value, updated_at``: the latest set of each cursor, combined before the shuffle; null values are refused."""
    ok = sets.where("value is not null")
    at = F.struct("updated_at", "ord")
    return ok.groupBy(*CURSOR).agg(F.max_by("value", at).alias("value"), F.max("updated_at").alias("updated_at"))


def get(sets: DataFrame, kind: str, key: str) -> DataFrame:
    return last_write_wins(sets.where((F.col("kind") == kind) & (F.col("key") == key))).select("value")


def archive_cursor(sets: DataFrame, key: str) -> DataFrame:
    return get(sets, ARCHIVE_KIND, key)


def height_of(value):
    """The height in a cursor's JSON value, where it is a JSON number; else null."""
    v = F.try_parse_json(value)
    return F.when(F.schema_of_variant(F.try_variant_get(v, "$.height", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|TINYINT|SMALLINT|INT)"), F.try_variant_get(v, "$.height", "decimal(38,0)"))


def monotone(sets: DataFrame) -> DataFrame:
    """Cursors whose sets are dropped unless their numeric height exceeds the stored numeric one; others win by time.

    Where all heights of a cursor are numbers this is the first set of the largest height, an aggregate; the other cursors go
    through an ordered fold that streams through sorted rows.
    """
    rows = sets.where("value is not null").withColumn("h", height_of("value"))
    best = F.max_by(F.struct("value", "updated_at"), F.struct("h", (-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("t"), (-F.col("ord")).alias("o")))
    by_key = rows.groupBy(*CURSOR).agg(best.alias("b"), F.max(F.col("h").isNull()).alias("odd"))

    def step(state, row):
        new = None if row.h is None else int(row.h)
        old = state.get("h")
        if not state or new is None or old is None or new > old:
            state.update(h=new, value=row.value, at=row.updated_at)
        return []

    odd = rows.join(by_key.where("odd").select(*CURSOR), CURSOR, "left_semi").withColumn("h", F.col("h").cast("string"))
    folded = ordered_fold(
        odd, CURSOR, ["updated_at", "ord"], dict, step, "kind string, key string, value string, updated_at timestamp", lambda s, key: [(*key, s["value"], s["at"])]
    )
    return by_key.where("not odd").select(*CURSOR, "b.value", "b.updated_at").unionByName(folded)


def ahead_of_data(cursors: DataFrame, done: DataFrame, bucket: int = 1_000_000) -> DataFrame:
    """``kind, key, low, high``: runs of steps from 1 to each cursor's height that ``done`` (``kind, key, height``) lacks.

    A cursor must never be ahead. Steps are compared with the one before within buckets, the last of the bucket before
    carried in: the work follows the rows of ``done``, not the heights.
    """
    own = cursors.where("height > 0").select(*CURSOR, F.col("height").cast("long").alias("top"))
    steps = done.join(own, CURSOR).where("height between 1 and top").select(*CURSOR, F.col("height").cast("long").alias("height"))
    steps = steps.unionByName(own.select(*CURSOR, (F.col("top") + 1).alias("height"))).withColumn("_b", F.floor(F.col("height") / bucket))
    last = steps.groupBy(*CURSOR, "_b").agg(F.max("height").alias("_last"))
    carried = last.select(*CURSOR, "_b", F.lag("_last", 1, 0).over(Window.partitionBy(*CURSOR).orderBy("_b")).alias("_in"))
    within = F.lag("height").over(Window.partitionBy(*CURSOR, "_b").orderBy("height"))
    seen = steps.withColumn("_own", within).join(carried, [*CURSOR, "_b"]).withColumn("_p", F.coalesce("_own", "_in"))
    return seen.where("height > _p + 1").select(*CURSOR, (F.col("_p") + 1).alias("low"), (F.col("height") - 1).alias("high"))


def state_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one state that the other lacks, both ways, repeats counted; empty for equal states."""
    left, right = a.exceptAll(b.select(*a.columns)), b.select(*a.columns).exceptAll(a)
    return left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right")))
