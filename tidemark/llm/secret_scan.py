"""Secret scan with multipart credential linking, in built-in functions alone.

Patterns are located without any per-row code: the text split at a pattern gives the gaps, ``regexp_extract_all`` the
matches, and running sums of their lengths the spans in code points. Strong findings (assignments, access ids, long hex
runs) are reported as they are. Weaker candidates (account identifiers, other secrets, endpoints) are reported only where
complementary parts co-occur: each candidate, widened by ``scope`` code points on both sides, is interval-joined with the
identifiers and secrets of its text, and reported with the nearest ones.

The interval join is an equality join on pieces of ``scope`` code points: a part is sent to the pieces it touches, and a pair
counts in the first piece that both touch. Matches of a kind don't overlap, so within a piece there are few, and the pairs
grow with the text, not with the square of its parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, written

#: Base kinds in listed order: pattern, and what a match must satisfy (fixed values).
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]+"),
)
#: Weak kinds: the part they can be, and their pattern (fixed values).
WEAK = (
    ("account", "identifier", r"""(?i)(?<![A-Za-z0-9_])(?:access_?key_?id|client_?id|account_?id|tenant_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}+"""),
    ("cipher", "secret", r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z/+]*+[0-9])(?=[a-z0-9/+]*+[A-Z])[A-Za-z0-9+/]{32,}+={0,2}(?![A-Za-z0-9+/=_-])"),
    ("phrase", "secret", r"""(?i)(?<![A-Za-z0-9_])(?:pwd|passphrase|private_?key|client_?key|auth_?key|credential)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}+"""),
    ("endpoint", "endpoint", r"""(?i)(?<![A-Za-z0-9_])[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]{3,}+"""),
)
#: What a text must contain for a kind's pattern to match anywhere: found faster than the pattern (fixed values).
SIGNS = {"assign": (":", "="), "access": ("AKIA",), "account": (":", "="), "phrase": (":", "="), "endpoint": ("://",)}
PART = {"assign": "secret", "access": "identifier", "hex": "secret"} | {kind: part for kind, part, _ in WEAK}
ORDER = {kind: i for i, kind in enumerate([*(k for k, _ in BASE), *(k for k, _, _ in WEAK)])}
_ONE = "struct<s:int,k:int,e:int>"
_BLOCK = 256


def _running(lengths: Column) -> Column:
    """Exclusive running sums of an int array, in blocks so that long arrays don't cost their square."""
    starts = F.when(F.size(lengths) > 0, F.sequence(F.lit(1), F.size(lengths), F.lit(_BLOCK))).otherwise(F.array().cast("array<int>"))
    totals = F.transform(starts, lambda s: F.aggregate(F.slice(lengths, s, _BLOCK), F.lit(0), lambda a, x: a + x))
    bases = F.aggregate(totals, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    paired = F.arrays_zip(starts.alias("s"), F.slice(bases, 1, F.greatest(F.size(starts), F.lit(1))).alias("b"))

    def block(z: Column) -> Column:
        part = F.slice(lengths, z["s"], _BLOCK)
        sums = F.aggregate(part, F.array(z["b"]), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(sums, 1, F.size(part))

    return F.flatten(F.transform(F.filter(paired, lambda z: z["s"].isNotNull()), block))


def _found(text: str, kind: str, pattern: str) -> Column:
    """Whether the pattern matches; most texts are settled by a search for plain signs."""
    signs = [F.contains(F.col(text), F.lit(x)) for x in SIGNS.get(kind, ())]
    return reduce(lambda a, b: a | b, signs) & F.col(text).rlike(pattern) if signs else F.col(text).rlike(pattern)


def located(df: DataFrame, text: str, kind: str, pattern: str, out: str) -> DataFrame:
    """Adds ``out``: an array of ``s, e, v`` (start, end and text) of the leftmost non-overlapping matches."""
    hits, gaps, lengths, starts = free_name(df, "hits", "gaps", "lengths", "starts")
    some = _found(text, kind, pattern)
    df = df.withColumn(hits, F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(lengths, F.transform(hits, lambda h, i: F.length(h) + F.length(F.get(F.col(gaps), i))))
    df = df.withColumn(starts, _running(F.col(lengths)))
    span = F.transform(
        hits,
        lambda h, i: F.struct(
            (F.get(F.col(starts), i) + F.length(F.get(F.col(gaps), i))).alias("s"),
            (F.get(F.col(starts), i) + F.get(F.col(lengths), i)).alias("e"),
            h.alias("v"),
        ),
    )
    return df.withColumn(out, span).drop(hits, gaps, lengths, starts)


def _passing(kind: str):
    """The test that a match of a base kind must satisfy."""
    if kind == "assign":
        return lambda hit: F.length(F.regexp_extract(hit["v"], BASE[0][1], 2)) >= 6
    return lambda hit: F.length(hit["v"]) >= {"access": 20, "hex": 24}[kind]


def _spans(kind: str) -> Column:
    return F.transform(f"at_{kind}", lambda hit: F.struct(hit["s"].alias("s"), F.lit(ORDER[kind]).alias("k"), hit["e"].alias("e")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 400) -> DataFrame:
    """One row per input row: ``id_col, base, weak, links``: sorted arrays of ``s, k, e`` (start, rank of the kind, end).

    ``links`` has, beside each weak candidate, the nearest ``identifier`` and ``secret`` within ``scope``, where there is one.

    Null or empty text has no findings. Rows that share id and text share their findings; rows without an id are
    scanned too. Other columns are not read. An empty table gives no rows.
    """
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    for kind, pattern in BASE:
        df = located(df, "text", kind, r"[0-9a-f]{24,}" if kind == "hex" else pattern, f"at_{kind}")
        df = df.withColumn(f"at_{kind}", F.filter(f"at_{kind}", _passing(kind)))
    df = df.withColumn("base", F.array_sort(F.concat(*[_spans(k) for k, _ in BASE])))
    # a weak part needs an identifier and a secret in its text, strong or weak: most texts end here
    identifier = F.size("at_access") > 0
    secret = (F.size("at_assign") > 0) | (F.size("at_hex") > 0)
    account, cipher, phrase, endpoint = (_found("text", kind, pattern) for kind, _, pattern in WEAK)
    linkable = (identifier & (cipher | phrase | endpoint)) | (secret & (account | endpoint)) | (account & (cipher | phrase))
    staged = written(df.select("id", "mark", "base", F.when(linkable, F.col("text")).alias("text")), "secret-spans")
    found = staged.where("text is not null")
    for kind, _, pattern in WEAK:
        found = located(found, "text", kind, pattern, f"at_{kind}")
    parts = found.select("id", "mark", F.explode(F.concat("base", *[_spans(k) for k, _, _ in WEAK])).alias("x")).select("id", "mark", "x.s", "x.k", "x.e").distinct()
    per_text = written(_linked(parts, scope), "linked-secrets").groupBy("id", "mark").agg(F.array_sort(F.collect_list(F.struct("s", "k", "e", "identifier", "secret"))).alias("links"))
    per_text = per_text.select(F.col("id").alias("weak_id"), F.col("mark").alias("weak_mark"), "links")
    out = staged.select("id", "mark", "base").join(per_text, F.col("id").eqNullSafe(F.col("weak_id")) & (F.col("mark") == F.col("weak_mark")), "left")
    links = F.coalesce("links", F.array().cast(f"array<struct<s:int,k:int,e:int,identifier:{_ONE},secret:{_ONE}>>"))
    return out.select(F.col("id").alias(id_col), "base", F.transform(links, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))).alias("weak"), links.alias("links"))


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """Weak parts of ``id, mark, s, k, e`` that have their complements within ``scope``: with the nearest ``identifier`` and ``secret``."""
    size = max(1, scope)
    is_part = lambda p: F.col("k").isin(*[ORDER[k] for k, q in PART.items() if q == p])
    pieces = lambda low, high: F.sequence(F.floor(F.greatest(low, F.lit(0)) / size).cast("int"), F.floor(high / size).cast("int"))
    weak = parts.where(F.col("k") >= len(BASE)).withColumn("touched", pieces(F.col("s") - scope, F.col("e") + scope))
    weak = weak.withColumn("own_piece", F.col("touched")[0]).select("id", "mark", "s", "k", "e", "own_piece", F.explode("touched").alias("piece"))
    near = parts.where(is_part("identifier") | is_part("secret")).withColumn("touched", pieces(F.col("s"), F.col("e")))
    near = near.select(
        F.col("id").alias("near_id"), F.col("mark").alias("near_mark"), F.struct("s", "k", "e").alias("x"), is_part("identifier").alias("names"), F.col("touched")[0].alias("near_piece"),
        F.explode("touched").alias("at_piece"),
    )
    meet = F.col("id").eqNullSafe(F.col("near_id")) & (F.col("mark") == F.col("near_mark")) & (F.col("piece") == F.col("at_piece"))
    within = (F.col("x.s") <= F.col("e") + scope) & (F.col("x.e") >= F.col("s") - scope) & (F.struct("s", "k", "e") != F.col("x"))
    pairs = weak.join(near, meet & (F.col("piece") == F.greatest("own_piece", "near_piece")) & within)
    distance = F.struct(F.greatest(F.col("x.s") - F.col("e"), F.col("s") - F.col("x.e"), F.lit(0)).alias("d"), F.col("x").alias("x"))
    found = pairs.groupBy("id", "mark", "s", "k", "e").agg(
        F.min(F.when(F.col("names"), distance))["x"].alias("identifier"), F.min(F.when(~F.col("names"), distance))["x"].alias("secret"),
        F.max((F.col("x.k") < len(BASE)) & (F.col("x.s") < F.col("e")) & (F.col("s") < F.col("x.e"))).alias("within_strong"),
    )
    needs = F.when(is_part("identifier"), F.col("secret").isNotNull()).when(is_part("secret"), F.col("identifier").isNotNull())
    return found.where(~F.col("within_strong") & needs.otherwise(F.col("identifier").isNotNull() & F.col("secret").isNotNull())).drop("within_strong")


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
