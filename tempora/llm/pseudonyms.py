"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their validation are permuted within their format by a keyed Feistel
network: a value always becomes the same other value, in every document, and the holder of the
key can undo it.  Digits stay digits, addresses stay addresses, card numbers keep a right check
digit, dates stay dates between 1900 and 2099.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# Patterns of what may be personal; every kind is validated before it is replaced.  The repeated
# group is possessive, as any other is matched by recursion, one level a repeat.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)++"
ADDRESS = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
PHONE = r"(?<![\d+])\+\d{1,3}[ -]?\(?\d{2,4}\)?[ -]?\d{3,4}[ -]?\d{4}(?!\d)"
DATE = r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!\d)"
CARD = r"(?<![\dA-Za-z])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?![\dA-Za-z])"
TOKEN = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
KINDS = ("email", "phone", "address", "date", "card", "token")
#: CARD comes first, as its group is numbered.
ANY = "|".join((CARD, EMAIL, PHONE, ADDRESS, DATE, TOKEN))
# 1900-01-01 to 2099-12-31 are 73049 days, 17 times 4297.
FIRST_DAY, LONG_DAYS, SHORT_DAYS = "1900-01-01", 4297, 17
DATE_FORMS = ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy")


def stream(key: str, tag: str, turn: Column, other: Column) -> Column:
    """64 numbers below 256 that depend on the key, the format, the round and the other half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), turn.cast("string"), F.size(other).cast("string"), F.array_join(other, ",")), 512)
    return F.transform(F.split(digest, r"(?<=\G.{2})"), lambda h: F.conv(h, 16, 10).cast("int"))


def feistel(values: Column, radix: int, key: str, tag: str) -> Column:
    """Permutes arrays of numbers below ``radix``, each length on its own, by adding to one half what the other half yields."""
    half = F.floor(F.size(values) / 2).cast("int")
    start = F.struct(F.slice(values, 1, half).alias("l"), F.slice(values, half + 1, F.size(values) - half).alias("r"))

    def add(to: Column, numbers: Column) -> Column:
        # Halves of more than 64 places take the numbers again.
        again = F.flatten(F.array_repeat(numbers, F.ceil(F.size(to) / 64).cast("int")))
        return F.zip_with(to, F.slice(again, 1, F.size(to)), lambda a, b: F.pmod(a + b, F.lit(radix)))

    def turn(acc: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, add(acc["l"], stream(key, tag, i, acc["r"]))).otherwise(acc["l"])
        right = F.when(i % 2 == 1, add(acc["r"], stream(key, tag, i, acc["l"]))).otherwise(acc["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda acc: F.concat(acc["l"], acc["r"]))


def digits_of(value: Column, alphabet: str) -> Column:
    """Places in ``alphabet`` of the characters of ``value`` that are in it."""
    kept = F.filter(F.split(value, ""), lambda c: (c != "") & (F.instr(F.lit(alphabet), c) > 0))
    return F.transform(kept, lambda c: F.instr(F.lit(alphabet), c) - 1)


def refill(value: Column, numbers: Column, alphabet: str) -> Column:
    """``value`` with its characters of ``alphabet`` replaced, in order, by those at ``numbers``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    letters = F.split(F.lit(alphabet), "")

    def put(acc: Column, c: Column) -> Column:
        mine = (c != "") & (F.instr(F.lit(alphabet), c) > 0)
        new = F.element_at(letters, F.element_at(numbers, acc["n"] + 1) + 1)
        return F.struct(F.concat(acc["out"], F.when(mine, new).otherwise(c)).alias("out"), (acc["n"] + mine.cast("int")).alias("n"))

    return F.aggregate(F.split(value, ""), start, put, lambda acc: acc["out"])


def luhn_sum(numbers: Column) -> Column:
    """Sum of the digits, every second from the right doubled (casting out nines)."""
    doubled = F.transform(F.reverse(numbers), lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def a_date(value: Column) -> Column:
    """The date that ``value`` writes, null unless it is one between 1900 and 2099."""
    day = F.coalesce(*[F.when(value.rlike(p), F.try_to_date(value, f)) for p, f in zip((r"^\d{4}-", r"^\d{2}\.", r"^\d{2}/"), DATE_FORMS, strict=True)])
    return F.when((day >= F.lit(FIRST_DAY).cast("date")) & (day <= F.lit("2099-12-31").cast("date")), day)


def kind_of(value: Column) -> Column:
    """The kind of a match, null if it does not pass validation."""
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("int"))
    return (
        F.when(value.contains("@"), F.lit("email"))
        .when(value.startswith("+"), F.when(F.size(digits_of(value, "0123456789")).between(8, 15), F.lit("phone")))
        .when(value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(F.forall(octets, lambda o: o < 256), F.lit("address")))
        .when(value.rlike(DATE), F.when(a_date(value).isNotNull(), F.lit("date")))
        .when(value.rlike(r"^[\d -]{13,19}$"), F.when(luhn_sum(digits_of(value, "0123456789")) % 10 == 0, F.lit("card")))
        .otherwise(F.lit("token"))
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The other value of the same kind and format; the value itself where the kind is null."""
    ten, hexes, letters = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    card = digits_of(value, ten)
    body = feistel(F.slice(card, 1, F.size(card) - 1), 10, key, "card")
    check = F.pmod(-luhn_sum(F.concat(body, F.array(F.lit(0)))), F.lit(10))
    octets = feistel(F.transform(F.split(value, r"\."), lambda o: o.cast("int")), 256, key, "address")
    code, rest = F.regexp_extract(value, r"^\+\d{1,3}(?=[ (-])|^\+\d", 0), F.regexp_replace(value, r"^(?:\+\d{1,3}(?=[ (-])|\+\d)", "")
    token = F.lower(value)
    coded = refill(token, feistel(digits_of(token, hexes), 16, key, "token"), hexes)
    name, host = F.lower(F.split_part(value, F.lit("@"), F.lit(1))), F.split_part(value, F.lit("@"), F.lit(2))
    name = refill(name, feistel(digits_of(name, letters), 26, key, "email"), letters)
    name = refill(name, feistel(digits_of(name, ten), 10, key, "email"), ten)
    number = F.datediff(a_date(value), F.lit(FIRST_DAY).cast("date"))
    long, short = F.floor(number / SHORT_DAYS).cast("int"), F.pmod(number, F.lit(SHORT_DAYS))
    for i in range(ROUNDS):
        yielded = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(f"date{i}"), (short if i % 2 == 0 else long).cast("string")), 256), 1, 12), 16, 10).cast("long")
        if i % 2 == 0:
            long = F.pmod(long + yielded, F.lit(LONG_DAYS))
        else:
            short = F.pmod(short + yielded, F.lit(SHORT_DAYS))
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (long * SHORT_DAYS + short).cast("int"))
    dated = F.when(value.contains("-"), F.date_format(day, DATE_FORMS[0])).when(value.contains("."), F.date_format(day, DATE_FORMS[1])).otherwise(F.date_format(day, DATE_FORMS[2]))
    return (
        F.when(kind == "card", refill(value, F.concat(body, F.array(check)), ten))
        .when(kind == "address", F.array_join(octets, "."))
        .when(kind == "phone", F.concat(code, refill(rest, feistel(digits_of(rest, ten), 10, key, "phone"), ten)))
        .when(kind == "token", F.when(value == token, coded).otherwise(F.upper(coded)))
        .when(kind == "email", F.concat(name, F.lit("@"), host))
        .when(kind == "date", dated)
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Replaces personal data in whole texts: the columns of ``docs`` and n_email, n_phone, n_address, n_date, n_card, n_token.

    ``docs`` needs text; other columns, of any name, are kept.  A null text stays null, with no finds.
    Numbers that fail validation (wrong check digit, octets above 255, dates that do not exist or lie
    outside 1900 to 2099) stay as they are.  Of a mail address the local part is replaced, letters by
    lower-case letters and digits by digits; other characters and the host stay.  Of a phone number the
    country code stays.  Key tokens of 32 to 64 hexadecimal digits are permuted as numbers of base 16;
    upper and lower case are one value.  Equal values of a kind get equal pseudonyms in every row.
    Whoever has ``key`` can undo all of this, so it belongs with the secrets of a deployment.  Texts of
    any length are read whole; repeated rows are treated alike; an empty table gives an empty result.
    """
    taken = {c.lower() for c in docs.columns}
    mine = {k: k if k not in taken else f"{k}_found" for k in (f"n_{k}" for k in KINDS)}
    text = F.col("text")
    some = text.rlike(r"\d{4}|@|\d\.\d|[0-9a-fA-F]{32}")
    d = docs.withColumn("__found", F.when(some, F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda v: F.struct(v.alias("v"), kind_of(v).alias("k")))).otherwise(F.array().cast("array<struct<v:string,k:string>>")))
    d = d.withColumn("__new", F.transform("__found", lambda m: pseudonym(m["v"], m["k"], key)))
    gaps = F.split(text, ANY, -1)
    pieces = F.zip_with(gaps, F.col("__new"), lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    d = d.withColumn("text", F.when(F.size("__found") > 0, F.array_join(pieces, "")).otherwise(text))
    for kind, name in zip(KINDS, mine.values(), strict=True):
        d = d.withColumn(name, F.coalesce(F.size(F.array_remove(F.transform("__found", lambda m: F.coalesce(m["k"] == F.lit(kind), F.lit(False))), False)), F.lit(0)).cast("long"))  # noqa: B023
    return d.select(*docs.columns, *mine.values())
