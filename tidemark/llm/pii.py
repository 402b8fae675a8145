"""PII pseudonyms that keep their format, by keyed Feistel networks, in built-in functions alone.

Validated card numbers, phone numbers, IPv4 addresses, social security numbers, dates, and the local parts of e-mail addresses
are permuted within their own format: digits stay digits, separators and letter case stay in place, card
numbers stay Luhn-valid, dates stay dates, country codes stay, area codes and octets stay in range. Each permutation is an alternating Feistel network over two residues,
``a' = (a + F(b)) mod p``, with F from SHA-256 of the key, the format and the round. It is a bijection on
its format, so equal values get equal pseudonyms in every document and different values different ones, and the holder of
the key can invert it. A date is permuted as a day of the 400 years from 1800 on, the same in ISO, dotted and day-first notation;
slashed dates that can only be month first are permuted among themselves.

A text is cut at the matches of one pattern; pieces and pseudonyms are joined again. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

ROUNDS = 8
#: Patterns of the kinds, tried in this order (fixed values).
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}+(?![0-9])"
IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9./-])(?:(?:1[89]|2[01])[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:1[89]|2[01])[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:1[89]|2[01])[0-9]{2})(?![0-9])"
PHONE = r"(?<![0-9+(])(?:\+?1[\x20.-]?)?(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])|(?<![0-9+])\+[1-9][0-9]{0,2}(?:[\x20.-]?[0-9]{2,4}){2,4}(?![0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])"
ANY = "|".join((EMAIL, IPV4, DATE, SSN, PHONE, CARD))
#: Days of a full Gregorian cycle, 189 * 773, and where it begins (fixed values).
CYCLE, CYCLE_PARTS, CYCLE_START = 146_097, (189, 773), "1800-01-01"
#: Notations of dates.
NOTATIONS = ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy")
#: Days of the cycle's 4800 months beyond each one's twelfth: those that only a month-first notation can mean, 3 * 29499 (fixed values).
LATE_DAYS, LATE_PARTS, MONTHS = 88_497, (3, 29_499), 4800
#: Country codes of one and two digits; all others have three (fixed values).
COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _digest(*parts: Column) -> Column:
    """60 bits of SHA-256 as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, p: Column, q: Column, key: str, kind: str) -> Column:
    """Permutes the pair (a mod p, b mod q); a struct of ``a`` and ``b``. Works for any two moduli below 2**59."""

    def step(state: Column, r: Column) -> Column:
        salt = (F.lit(f"{key}|{kind}"), p.cast("string"), q.cast("string"), r.cast("string"))
        even = r % 2 == 0
        return F.struct(
            F.when(even, F.pmod(state["a"] + _digest(*salt, state["b"].cast("string")), p)).otherwise(state["a"]).alias("a"),
            F.when(even, state["b"]).otherwise(F.pmod(state["b"] + _digest(*salt, state["a"].cast("string")), q)).alias("b"),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order by ``digits``."""
    one = F.transform(
        F.sequence(F.lit(1), F.length(shape)),
        lambda i: F.when(
            F.substr(shape, i, F.lit(1)).rlike("[0-9]"), F.substr(digits, F.length(_digits(F.substr(shape, F.lit(1), i))), F.lit(1))
        ).otherwise(F.substr(shape, i, F.lit(1))),
    )
    return F.array_join(one, "")


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**k).cast("long") for k in range(13)]), n + 1)


def _permuted(digits: Column, key: str, kind: str) -> Column:
    """A digit string of 2 to 24 digits permuted among those of its length."""
    half = (F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    pair = feistel(F.substr(digits, F.lit(1), half), F.substr(digits, half + 1, rest), _power(half), _power(rest), key, kind)
    return F.concat(F.lpad(pair["a"].cast("string"), half, F.lit("0")), F.lpad(pair["b"].cast("string"), rest, F.lit("0")))


def _luhn_sum(digits: Column, first_doubled: int) -> Column:
    """Luhn sum from the right; every second digit doubled, from the ``first_doubled``-th (0: the last)."""
    places = F.transform(
        F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == first_doubled, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int"))
    )
    return F.aggregate(F.filter(places, lambda x: x.isNotNull()), F.lit(0), lambda acc, x: acc + x)


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    new = _permuted(body, key, "card")
    check = F.pmod(-_luhn_sum(new, 0), F.lit(10)).cast("string")
    return _refill(m, F.concat(new, check))


def _phone(m: Column, key: str) -> Column:
    """National ten-digit numbers (a leading 1 stays) keep valid area and exchange codes; those of other countries keep their country code."""
    digits = _digits(m)
    ten = F.substring(digits, -10, 10)
    lead = F.substr(digits, F.lit(1), F.length(digits) - 10)
    floor = lambda part: F.when(part.cast("int") >= 200, 200).otherwise(0)
    area, exchange, line = F.substring(ten, 1, 3), F.substring(ten, 4, 3), F.substring(ten, 7, 4).cast("long")
    a0, e0 = floor(area), floor(exchange)
    size = lambda f: F.when(f == 200, 800).otherwise(200)
    b = (exchange.cast("long") - e0) * 10_000 + line
    pair = feistel(area.cast("long") - a0, b, size(a0).cast("long"), (size(e0) * 10_000).cast("long"), key, "phone")
    new = F.concat(
        lead, F.lpad((pair["a"] + a0).cast("string"), 3, "0"), F.lpad((F.floor(pair["b"] / 10_000) + e0).cast("string"), 3, "0"), F.lpad((pair["b"] % 10_000).cast("string"), 4, "0")
    )
    code = F.regexp_extract(F.concat(F.lit("+"), digits), COUNTRY, 1)
    abroad = F.concat(code, _permuted(F.substr(digits, F.length(code) + 1, F.length(digits) - F.length(code)), key, "phone-abroad"))
    national = F.when(F.startswith(m, F.lit("+")), (F.length(digits) == 11) & digits.startswith("1")).otherwise(True)
    return _refill(m, F.when(national, new).otherwise(abroad))


def _ssn(m: Column, key: str) -> Column:
    """The area keeps its validity class (001-665, 667-899), group and serial stay above zero."""
    area, group, serial = (F.element_at(F.split(m, "-"), i).cast("long") for i in (1, 2, 3))
    a = F.when(area > 666, area - 2).otherwise(area - 1)
    pair = feistel(a, (group - 1) * 9999 + serial - 1, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), key, "ssn")
    new = F.when(pair["a"] >= 665, pair["a"] + 2).otherwise(pair["a"] + 1)
    return F.format_string("%03d-%02d-%04d", new, F.floor(pair["b"] / 9999) + 1, pair["b"] % 9999 + 1)


def _ipv4(m: Column, key: str) -> Column:
    o = [F.element_at(F.split(m, r"\."), i).cast("long") for i in (1, 2, 3, 4)]
    q = F.lit(65_536).cast("long")
    pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], q, q, key, "ipv4")
    return F.concat_ws(".", *[x.cast("long").cast("string") for n in ("a", "b") for x in (F.floor(pair[n] / 256), pair[n] % 256)])


def _date(m: Column, key: str) -> Column:
    """ISO, dotted (day first) and slashed dates; impossible ones stay as they are.

    A slashed date is day first if it can be. One that can only be month first becomes another such date, so that no two
    dates of one notation share a pseudonym.
    """
    start = F.lit(CYCLE_START).cast("date")
    out = m
    for notation in NOTATIONS[:3]:
        n = F.datediff(F.to_date(F.try_to_timestamp(m, F.lit(notation))), start)
        pair = feistel(F.floor(n / CYCLE_PARTS[1]), n % CYCLE_PARTS[1], F.lit(CYCLE_PARTS[0]).cast("long"), F.lit(CYCLE_PARTS[1]).cast("long"), key, "date")
        moved = F.date_add(start, (pair["a"] * CYCLE_PARTS[1] + pair["b"]).cast("int"))
        out = F.when(n.between(0, CYCLE - 1), F.date_format(moved, notation)).otherwise(out)
    # days after a month's twelfth are numbered without the first twelve of all months up to theirs
    day = F.to_date(F.try_to_timestamp(m, F.lit(NOTATIONS[3])))
    n = F.datediff(day, start) - 12 * (12 * (F.year(day) - 1800) + F.month(day))
    pair = feistel(F.floor(n / LATE_PARTS[1]), n % LATE_PARTS[1], F.lit(LATE_PARTS[0]).cast("long"), F.lit(LATE_PARTS[1]).cast("long"), key, "date-month-first")
    new = pair["a"] * LATE_PARTS[1] + pair["b"]
    # months are near equal in late days: the month is the one this says, or a neighbour
    before = lambda month: F.datediff(F.add_months(start, month), start) - 12 * month
    guess = F.floor(new * MONTHS / LATE_DAYS).cast("int")
    month = F.when(before(guess + 1) <= new, guess + 1).when(before(guess) <= new, guess).otherwise(guess - 1)
    moved = F.date_add(F.add_months(start, month), (new - before(month) + 12).cast("int"))
    return F.when(out.eqNullSafe(m) & F.contains(m, F.lit("/")) & (F.dayofmonth(day) > 12) & F.year(day).between(1800, 2199), F.date_format(moved, NOTATIONS[3])).otherwise(out)


def _letters(text: Column, stream: Column) -> Column:
    """Each letter and digit moved within its class by the stream's two hex digits at its place."""
    c = lambda i: F.substr(text, i, F.lit(1))
    by = lambda i: F.conv(F.substr(stream, (i - 1) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    move = lambda i, alphabet: F.substr(F.lit(alphabet), F.pmod(F.instr(F.lit(alphabet), c(i)) - 1 + by(i), F.lit(len(alphabet))) + 1, F.lit(1))

    def one(i: Column) -> Column:
        out = c(i)
        for alphabet in (LOWER, UPPER, DIGITS):
            out = F.when(F.instr(F.lit(alphabet), c(i)) > 0, move(i, alphabet)).otherwise(out)
        return out

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")).otherwise(F.lit(""))


def _email(m: Column, key: str) -> Column:
    """The local part, permuted among those of its shape; the domain stays."""
    local = F.substring_index(m, "@", 1)
    half = (F.length(local) / 2).cast("int")

    def step(state: Column, r: Column) -> Column:
        salt = (F.lit(f"{key}|email"), F.length(local).cast("string"), r.cast("string"))
        # two hex digits a letter, 32 letters a digest
        stream = lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.floor(half / 32).cast("int")), lambda i: F.sha2(F.concat_ws("|", *salt, i.cast("string"), x), 256)), "")
        even = r % 2 == 0
        return F.struct(
            F.when(even, _letters(state["a"], stream(state["b"]))).otherwise(state["a"]).alias("a"),
            F.when(even, state["b"]).otherwise(_letters(state["b"], stream(state["a"]))).alias("b"),
        )

    start = F.struct(F.substr(local, F.lit(1), half).alias("a"), F.substr(local, half + 1, F.length(local) - half).alias("b"))
    pair = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS // 2 - 1)), start, step)
    return F.concat(pair["a"], pair["b"], F.lit("@"), F.substring_index(m, "@", -1))


def kind_of(m: Column) -> Column:
    """The kind of a match; null for a number that fails its check sum and for a date that isn't in the calendar."""
    out = F.when(_luhn_sum(_digits(m), 1) % 10 == 0, "card")
    dated = F.coalesce(*[F.try_to_timestamp(m, F.lit(n)) for n in NOTATIONS])
    for kind, pattern in (("phone", PHONE), ("ssn", SSN), ("date", DATE), ("ipv4", IPV4), ("email", EMAIL)):
        known = F.when(dated.isNotNull(), kind) if kind == "date" else F.lit(kind)
        out = F.when(m.rlike(f"^(?:{pattern})$"), known).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` pseudonymised, plus ``n_numbers, n_dates, n_emails`` (values replaced).

    Null text stays null and counts 0; empty text stays empty. Numbers that fail validation (Luhn, octets, calendar)
    stay as they are. Repeated rows stay and are treated alike; an empty table gives no rows. Other columns stay; columns of
    the three names are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_numbers", "n_dates", "n_emails")])
    hits, gaps, kinds, news = free_name(docs, "pii_hits", "pii_gaps", "pii_kinds", "pii_new")
    some = F.col(text_col).rlike("[0-9@]")
    none = F.array().cast("array<string>")
    df = docs.withColumn(hits, F.when(some, F.regexp_extract_all(text_col, F.lit(ANY), F.lit(0))).otherwise(none))
    df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.split(text_col, ANY, -1)).otherwise(none))
    df = df.withColumn(kinds, F.transform(hits, kind_of))

    def new(m: Column, i: Column) -> Column:
        out = m
        for name, made in (("card", _card), ("phone", _phone), ("ssn", _ssn), ("date", _date), ("ipv4", _ipv4), ("email", _email)):
            out = F.when(F.get(F.col(kinds), i) == name, made(m, key)).otherwise(out)
        return out

    df = df.withColumn(news, F.transform(hits, new))
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col(news), i), F.lit("")))), "")
    changed = lambda *names: F.size(F.filter(kinds, lambda k: F.coalesce(k.isin(*names), F.lit(False)))).cast("long")
    df = df.withColumns(
        {
            text_col: F.when(F.size(hits) > 0, joined).otherwise(F.col(text_col)),
            "n_numbers": changed("card", "phone", "ssn", "ipv4"),
            "n_dates": changed("date"),
            "n_emails": changed("email"),
        }
    )
    return df.drop(hits, gaps, kinds, news)
