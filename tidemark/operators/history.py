"""Transaction history: lifecycle-merged entries, pending entries cleared by finalised ones, checked encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import MAX_DEPTH, canonical_instant, canonical_integer, nesting, safe_text
from .fold import ordered_fold

ENTRY = ["wallet_id", "hash"]
SCALARS = ["protocol_version", "status", "timestamp", "fees"]
BIGINT_TAG, DATE_TAG, RESERVED = "$bigint", "$date", "$"


def merged(commands: DataFrame) -> DataFrame:
    """One entry per (wallet, hash): identifiers united, the last lifecycle, the first of each scalar fact that was set.

    Holds where no entry is cleared in between; :func:`replay` covers that too.
    """
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in SCALARS if c in commands.columns]
    return commands.groupBy(*ENTRY).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("identifiers")))).alias("identifiers"), F.max_by("kind", "ord").alias("lifecycle"), *firsts
    )


def merge_sections(old: Column, new: Column) -> Column:
    """Sections (a map of maps): keys of both; a section in both is merged leaf by leaf, the new one winning."""
    return F.map_zip_with(old, new, lambda _, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x))))


def merge_facts(old: Column, new: Column) -> Column:
    """Scalar sections: the first value wins."""
    return F.map_zip_with(old, new, lambda _, a, b: F.coalesce(a, b))


def cleared(entries: DataFrame) -> DataFrame:
    """Pending entries whose identifiers, not none, all belong to one finalised or rejected entry of their wallet.

    Set containment by equality: pending identifiers are joined to final ones, and a pair counts if it matches them all.
    """
    pending = entries.where("lifecycle = 'pending' and size(identifiers) > 0")
    p = pending.select(*ENTRY, F.size(F.array_distinct("identifiers")).alias("need"), F.explode(F.array_distinct("identifiers")).alias("i"))
    f = entries.where("lifecycle in ('finalized', 'rejected')").select("wallet_id", F.col("hash").alias("by"), F.explode(F.array_distinct("identifiers")).alias("i"))
    hit = p.join(f, ["wallet_id", "i"]).where("hash <> by").groupBy(*ENTRY, "by", "need").agg(F.count("*").alias("have")).where("have = need")
    return pending.join(hit.select(*ENTRY).distinct(), ENTRY, "left_semi")


def replay(commands: DataFrame) -> DataFrame:
    """Final entries after every command in order, with pending entries cleared at each finalise or reject.

    A wallet's commands are streamed in order; the state is its live entries, and which pending ones hold an identifier. A cleared
    hash seen again is a first write. Facts and, where there is a ``sections`` column (a map of maps), sections are merged.
    """

    def step(state, row):
        entries, holders = state
        entry = entries.get(row.hash)
        if entry is None:
            entry = entries[row.hash] = {"ids": {}, "facts": {}, "sections": {}}
        fresh = [i for i in (() if row.identifiers is None else row.identifiers) if i not in entry["ids"]]
        entry["ids"].update(dict.fromkeys(fresh))
        entry["kind"] = row.kind
        for c in facts:
            value = getattr(row, c)
            if value is not None and value == value:
                entry["facts"].setdefault(c, value)
        if with_sections and row.sections is not None:
            for name, leaves in dict(row.sections).items():
                entry["sections"].setdefault(name, {}).update(dict(leaves or {}))
        for i in entry["ids"]:
            (holders.setdefault(i, set()).add if row.kind == "pending" else holders.get(i, set()).discard)(row.hash)
        if row.kind in ("finalized", "rejected"):
            final = entry["ids"].keys()
            for other in {h for i in final for h in holders.get(i, ())} - {row.hash}:
                if entries[other]["ids"].keys() <= final:
                    for i in entries.pop(other)["ids"]:
                        holders[i].discard(other)
        return []

    facts, with_sections = [c for c in SCALARS if c in commands.columns], "sections" in commands.columns
    extra = ["sections"] if with_sections else []
    rows = commands.select(*ENTRY, "ord", "kind", "identifiers", *[F.col(c).cast("string").alias(c) for c in facts], *extra)
    schema = "wallet_id string, hash string, identifiers array<string>, lifecycle string" + "".join(f", {c} string" for c in facts)
    schema += ", sections map<string,map<string,string>>" if with_sections else ""
    finish = lambda state, key: [
        (key[0], h, sorted(e["ids"]), e["kind"], *(e["facts"].get(c) for c in facts), *([e["sections"]] if with_sections else [])) for h, e in sorted(state[0].items())
    ]
    return ordered_fold(rows, ["wallet_id"], ["ord"], lambda: ({}, {}), step, schema, finish)


def get_all(entries: DataFrame, wallet: str) -> DataFrame:
    return entries.where(F.col("wallet_id") == wallet).orderBy("hash")


def get(entries: DataFrame, wallet: str, tx_hash: str) -> DataFrame:
    return entries.where((F.col("wallet_id") == wallet) & (F.col("hash") == tx_hash))


def serialized(entries: DataFrame) -> DataFrame:
    """Each wallet's entries as one JSON text, ordered by hash. A wallet's history is one cell, as asked for."""
    others = [c for c in entries.columns if c != "wallet_id"]
    ordered = F.array_sort(F.collect_list(F.struct("hash", *[c for c in others if c != "hash"])))
    return entries.groupBy("wallet_id").agg(F.to_json(ordered).alias("json"))


def encode_tag(kind: str, value: Column) -> Column:
    """JSON of a big integer or an instant under its tag."""
    text = value.cast("decimal(38,0)").cast("string") if kind == BIGINT_TAG else F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.to_json(F.struct(text.alias(kind)))


def decode_tags(rows: DataFrame, raw: str) -> DataFrame:
    """Adds ``bigint_value``, ``date_value`` and ``problem`` for a JSON leaf: only canonical tagged forms decode."""
    number, date = F.get_json_object(raw, f"$['{BIGINT_TAG}']"), F.get_json_object(raw, f"$['{DATE_TAG}']")
    problem = F.when(number.isNotNull() & ~canonical_integer(number), "bigint").when(date.isNotNull() & ~canonical_instant(date), "date")
    return rows.withColumns({
        "bigint_value": F.when(problem.isNull() & (F.length(number) <= 38), number.try_cast("decimal(38,0)")),
        "date_value": F.when(problem.isNull(), F.try_to_timestamp(date)),
        "problem": problem,
    })


def content_problems(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Adds ``problem``: a reserved key, unsafe text, or nesting beyond the limit."""
    return rows.withColumn(
        "problem",
        F.when(F.startswith(key, F.lit(RESERVED)), "reserved").when(~safe_text(F.col(key)) | ~safe_text(F.col(value), 0), "unsafe").when(nesting(F.col(value)) > MAX_DEPTH, "depth"),
    )


def stored_problems(rows: DataFrame) -> DataFrame:
    """Stored entries of the wrong shape: missing names, an unknown lifecycle, fees or times that aren't canonical."""
    return rows.where(
        F.col("wallet_id").isNull() | F.col("hash").isNull() | F.coalesce(~F.col("lifecycle").isin("pending", "finalized", "rejected"), F.lit(True)) | F.col("identifiers").isNull()
        | (F.col("fees").isNotNull() & ~canonical_integer(F.col("fees"))) | (F.col("timestamp").isNotNull() & ~canonical_instant(F.col("timestamp")))
    )


#: Names of the adapter's statuses (fixed values).
STATUS = {"SUCCESS": "success", "PARTIAL_SUCCESS": "partialSuccess", "FAILURE": "failure"}


def map_status(c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair]), c)


def adapter_status(c: Column) -> Column:
    """The adapter's name of a stored status; null if there is none."""
    return F.element_at(F.create_map(*[F.lit(x) for name, stored in STATUS.items() for x in (stored, name)]), c)


#: The section that keeps what an adapter knows of a lifecycle beyond its name.
DETAIL = "lifecycle_detail"


def with_detail(commands: DataFrame, detail: Column) -> DataFrame:
    """Commands whose ``sections`` hold ``detail``, a struct, as JSON under their kind. Merges keep one detail a kind, the last."""
    own = F.create_map(F.lit(DETAIL), F.create_map("kind", F.to_json(detail)))
    old = F.coalesce("sections", F.create_map().cast("map<string,map<string,string>>")) if "sections" in commands.columns else F.create_map().cast("map<string,map<string,string>>")
    return commands.withColumn("sections", F.map_concat(F.map_filter(old, lambda k, _: k != DETAIL), own))


def claimed_details(commands: DataFrame) -> DataFrame:
    """Commands that bring a section of the reserved name themselves."""
    return commands.where(F.map_contains_key("sections", DETAIL))


def details(entries: DataFrame) -> DataFrame:
    """Entries with the ``detail`` of their present lifecycle, and ``problem`` where it is missing."""
    out = entries.withColumn("detail", F.element_at(F.element_at("sections", F.lit(DETAIL)), F.col("lifecycle")))
    return out.withColumn("problem", F.when(F.col("detail").isNull(), "SERIALIZATION_FAILED"))
