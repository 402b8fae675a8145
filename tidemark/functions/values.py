"""Value rules as column expressions: safe text, hex hashes, nesting, canonical numbers and dates."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH = 64


def safe_text(c: Column, low: int = 1, high: int | None = None) -> Column:
    """Valid UTF-8 without NUL and of allowed length."""
    ok = F.is_valid_utf8(c) & ~F.contains(c, F.lit("\x00")) & (F.length(c) >= low)
    return F.coalesce(ok & (F.length(c) <= high) if high else ok, F.lit(False))


def hex32(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def canonical_integer(c: Column) -> Column:
    """An integer in the one form that printing gives."""
    return F.coalesce(c.rlike(r"^-?(0|[1-9][0-9]*)$"), F.lit(False))


def canonical_instant(c: Column) -> Column:
    """An ISO instant with milliseconds and Z that parses and prints as itself."""
    at = F.try_to_timestamp(c)
    return F.coalesce(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z$") & (F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") == c), F.lit(False))


def nesting(c: Column) -> Column:
    """Depth of a JSON text: brackets outside strings, as a running sum's maximum."""
    plain = F.regexp_replace(c, r'"(?:[^"\\]|\\.)*"', "")
    steps = F.transform(F.split(F.regexp_replace(plain, r"[^\[\]{}]", ""), ""), lambda b: F.when(b.isin("[", "{"), 1).when(b.isin("]", "}"), -1).otherwise(0))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(steps, zero, lambda s, d: F.struct((s["now"] + d).alias("now"), F.greatest(s["most"], s["now"] + d).alias("most")), lambda s: s["most"])


def canonical_json(value) -> str:
    """Sorted keys, no white space: equal values give equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
