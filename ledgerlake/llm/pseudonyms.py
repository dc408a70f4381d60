"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Personal values are found in whole texts by pattern and validated (Luhn for cards, mod 97 for IBANs, real calendar
days, assignable social security numbers, octets; phone numbers by their length). Each is permuted by a keyed Feistel network over its
own format, so equal values get equal pseudonyms in all documents and different ones stay different:

- numbers are a pair (a, b) in Z_A x Z_B; the rounds add a keyed hash of one half to the other, modulo A or B, which
  is a permutation whatever A and B are. Cards keep their first digit and get a new check digit; phone numbers keep
  a leading 1; days stay within 1800 to 2199 (146097 = 189 * 773 days);
- letters and digits of e-mail names and account numbers are rotated within their own class by a keyed hash of the
  other half.

Values that fail their check stay. Nothing is shuffled.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

ROUNDS = 10
#: Where the session holds the secret key, and the public one that stands in for it in tests and trials.
KEY_SETTING, KEY = "spark.ledgerlake.pseudonym.key", "ledgerlake public example key"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
# Kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9])(?!\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}-[0-9]{6}-[0-9]{5}|[0-9]{4} [0-9]{6} [0-9]{5})(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def configured_key(spark: SparkSession) -> str:
    """The session's key. Without one the public key is used, and said so: anyone can undo its pseudonyms."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} isn't set: pseudonyms are made with the public example key and aren't secret", stacklevel=3)
    return key or KEY


def keyed(key: str, *parts: Column) -> Column:
    """64 hexadecimal digits from the key and the parts."""
    return F.sha2(F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts)), 256)


def permuted(key: str, kind: Column, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """struct(a, b) after ROUNDS rounds in Z_size_a x Z_size_b (long columns)."""

    def step(pair: Column, i: Column) -> Column:
        other = F.when(i % 2 == 0, pair["b"]).otherwise(pair["a"])
        add = F.conv(F.substring(keyed(key, kind, size_a, size_b, i, other), 1, 13), 16, 10).cast("long")
        return F.struct(F.when(i % 2 == 0, (pair["a"] + add) % size_a).otherwise(pair["a"]).alias("a"), F.when(i % 2 == 1, (pair["b"] + add) % size_b).otherwise(pair["b"]).alias("b"))

    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def rotated(text: Column, stream: Column) -> Column:
    """Each letter or digit moved on within its class, by two hexadecimal digits of the stream; other signs stay."""
    return let(stream, lambda s: rotated_by(text, s))


def rotated_by(text: Column, stream: Column) -> Column:
    def move(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        by = F.conv(F.substring(stream, F.pmod(2 * i - 2, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int")
        turn = lambda low, n: F.char(F.lit(low) + (F.ascii(c) - low + by) % n)
        return F.when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).when(c.between("0", "9"), turn(48, 10)).otherwise(c)

    return F.when(F.length(text) == 0, F.lit("")).otherwise(F.array_join(F.transform(positions(text), move), ""))


def scrambled(key: str, kind: Column, text: Column) -> Column:
    """A string with letters and digits permuted within their classes."""
    return let(text, lambda t: scrambled_value(key, kind, t))


def scrambled_value(key: str, kind: Column, text: Column) -> Column:
    half = (F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b"))

    def step(pair: Column, i: Column) -> Column:
        even = F.struct(rotated(pair["a"], keyed(key, kind, i, F.length(pair["a"]), pair["b"])).alias("a"), pair["b"].alias("b"))
        odd = F.struct(pair["a"].alias("a"), rotated(pair["b"], keyed(key, kind, i, F.length(pair["b"]), pair["a"])).alias("b"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), start, step, lambda x: F.concat(x["a"], x["b"]))


def positions(text: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))


def luhn_sum(payload: Column) -> Column:
    """Of the digits before a check digit: from the right, every other one, beginning with the first, doubled."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(payload, F.length(payload) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(positions(payload), F.lit(0), add)


def check_digit(payload: Column) -> Column:
    return let(payload, lambda p: ((10 - luhn_sum(p) % 10) % 10).cast("string"))


def mod97(account: Column) -> Column:
    """Of letters (as 10 to 35) and digits."""
    return let(account, mod97_of)


def mod97_of(account: Column) -> Column:
    def add(rest: Column, i: Column) -> Column:
        c = F.substring(account, i, F.lit(1))
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(positions(account), F.lit(0), add)


def refilled(like: Column, signs: Column, slot: str) -> Column:
    """`like` with its characters of the class `slot` replaced by `signs`, in order."""
    return let(signs, lambda new: refilled_with(like, new, slot))


def refilled_with(like: Column, signs: Column, slot: str) -> Column:
    def put(state: Column, i: Column) -> Column:
        c = F.substring(like, i, F.lit(1))
        hit = c.rlike(slot)
        return F.struct(F.concat(state["s"], F.when(hit, F.substring(signs, state["k"], F.lit(1))).otherwise(c)).alias("s"), (state["k"] + F.when(hit, 1).otherwise(0)).alias("k"))

    return F.aggregate(positions(like), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), put, lambda x: x["s"])


def padded(n: Column, width: Column | int) -> Column:
    return F.lpad(n.cast("string"), F.lit(width) if isinstance(width, int) else width, F.lit("0"))


DATE_FORMATS = [("-", "yyyy-MM-dd"), ("/", "MM/dd/yyyy"), (".", "dd.MM.yyyy")]


def kind_of(value: Column, digits: Column) -> Column:
    """The first kind whose pattern the whole value has and whose check it passes; null if none."""
    tight = F.regexp_replace(value, " ", "")
    checks = {
        "email": F.lit(True),
        "ip": F.lit(True),
        "date": F.coalesce(let(day_of(value), lambda day: day.between(0, 146096)), F.lit(False)),
        "ssn": (F.substring(digits, 1, 3) != "000") & (F.substring(digits, 1, 3) != "666") & (F.substring(digits, 1, 1) != "9") & (F.substring(digits, 4, 2) != "00") & (F.substring(digits, 6, 4) != "0000"),
        "phone": F.length(digits).between(10, 11),
        "iban": mod97(F.concat(F.substring(tight, F.lit(5), F.length(tight)), F.substring(tight, 1, 4))) == 1,
        "card": check_digit(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.substring(digits, F.length(digits), F.lit(1)),
    }
    out = F.lit(None).cast("string")
    for kind in reversed(PATTERNS):
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$") & checks[kind], F.lit(kind)).otherwise(out)
    return out


def day_of(value: Column) -> Column:
    """Days since 1800-01-01, null if the value is no real day."""
    out = F.lit(None).cast("int")
    for sign, form in DATE_FORMATS:
        out = F.when(value.contains(sign), F.datediff(F.try_to_timestamp(value, F.lit(form)).cast("date"), F.lit("1800-01-01").cast("date"))).otherwise(out)
    return out


def pseudonym(key: str, kind: Column, value: Column) -> Column:
    """The pseudonym of a validated value of a kind; a value without kind is its own."""
    out = value
    for name, make in {"email": new_email, "ip": new_ip, "date": new_date, "ssn": new_ssn, "phone": new_phone, "iban": new_iban, "card": new_card}.items():
        out = F.when(kind == name, make(key, value)).otherwise(out)
    return out


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def new_email(key: str, value: Column) -> Column:
    name = F.substring_index(value, "@", 1)
    return F.concat(scrambled(key, F.lit("email"), name), F.substring(value, F.length(name) + 1, F.length(value)))


def new_ip(key: str, value: Column) -> Column:
    def made(o: Column) -> Column:
        n = [F.get(o, F.lit(i)).cast("long") for i in range(4)]
        pair = permuted(key, F.lit("ip"), n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536))
        return let(pair, lambda p: F.concat_ws(".", F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256))

    return let(F.split(value, r"\."), made)


def new_date(key: str, value: Column) -> Column:
    def made(day: Column) -> Column:
        pair = permuted(key, F.lit("date"), F.floor(day / 773), day % 773, F.lit(189), F.lit(773))
        return let(pair, lambda p: F.date_add(F.lit("1800-01-01").cast("date"), (p["a"] * 773 + p["b"]).cast("int")))

    moved, shown = let(day_of(value).cast("long"), made), F.lit(None).cast("string")
    for sign, form in DATE_FORMATS:
        shown = F.when(value.contains(sign), F.date_format(moved, form)).otherwise(shown)
    return shown


def new_ssn(key: str, value: Column) -> Column:
    """Areas 001 to 899 but 666, groups from 01, serials from 0001."""
    part = lambda d, i, n: F.substring(d, i, n).cast("long")

    def made(d: Column) -> Column:
        area = part(d, 1, 3)
        pair = permuted(key, F.lit("ssn"), area - F.when(area > 666, 2).otherwise(1), (part(d, 4, 2) - 1) * 9999 + part(d, 6, 4) - 1, F.lit(898), F.lit(99 * 9999))
        return let(pair, lambda p: F.concat(padded(p["a"] + F.when(p["a"] >= 665, 2).otherwise(1), 3), padded(F.floor(p["b"] / 9999) + 1, 2), padded(p["b"] % 9999 + 1, 4)))

    return refilled(value, let(digits_of(value), made), "[0-9]")


def new_phone(key: str, value: Column) -> Column:
    def made(d: Column) -> Column:
        n = F.length(d)
        pair = permuted(key, F.lit("phone"), F.substring(d, n - 9, F.lit(3)).cast("long"), F.substring(d, n - 6, F.lit(7)).cast("long"), F.lit(1000), F.lit(10_000_000))
        return let(pair, lambda p: F.concat(F.substring(d, F.lit(1), n - 10), padded(p["a"], 3), padded(p["b"], 7)))

    return refilled(value, let(digits_of(value), made), "[0-9]")


def new_iban(key: str, value: Column) -> Column:
    def made(tight: Column) -> Column:
        country = F.substring(tight, 1, 2)
        account = scrambled(key, F.concat(F.lit("iban"), country), F.substring(tight, F.lit(5), F.length(tight)))
        return let(account, lambda x: F.concat(country, padded(98 - mod97(F.concat(x, country, F.lit("00"))), 2), x))

    return refilled(value, let(F.regexp_replace(value, " ", ""), made), "[A-Z0-9]")


def new_card(key: str, value: Column) -> Column:
    """The first digit, two halves that are permuted, and a check digit."""

    def made(d: Column) -> Column:
        n, first = F.length(d), F.substring(d, 1, 1)
        u = ((n - 2) / 2).cast("int")
        v = n - 2 - u
        tens = lambda m: F.pow(F.lit(10.0), m).cast("long")
        pair = permuted(key, F.concat(F.lit("card"), first), F.substring(d, F.lit(2), u).cast("long"), F.substring(d, u + 2, v).cast("long"), tens(u), tens(v))
        payload = let(pair, lambda p: F.concat(first, padded(p["a"], u), padded(p["b"], v)))
        return let(payload, lambda x: F.concat(x, check_digit(x)))

    return refilled(value, let(digits_of(value), made), "[0-9]")


def with_pseudonyms(docs: DataFrame, key: str | None = None, text: str = "text", found: str | None = None) -> DataFrame:
    """docs with every personal value of `text` replaced; `found` names a column for their kinds, in order.

    Null texts stay null and have no values; texts without a digit or an @ are not searched. Lengths change only
    with octets. Other columns are as they were, repeated rows stay repeated, very long texts are searched whole, and an
    empty table stays empty. Without a key the session's is used (configured_key).
    """
    whole, hits, rest, kinds = F.col(text), "__hits", "__pieces", "__kinds"
    if text not in docs.columns:
        raise ValueError(f"no column {text}")
    key = key or configured_key(docs.sparkSession)
    none = F.array().cast("array<string>")
    some = docs.withColumn(hits, F.when(whole.rlike("[0-9@]"), F.regexp_extract_all(whole, F.lit(ANY), F.lit(0))).otherwise(none))
    some = some.withColumn(kinds, F.transform(F.col(hits), lambda x: let(digits_of(x), lambda d: kind_of(x, d))))
    some = some.withColumn(rest, F.when(F.size(hits) > 0, F.split(whole, ANY, -1)).otherwise(none))
    # whatever stands before a value, the value's pseudonym, and what stands behind the last one
    parts = F.transform(F.col(hits), lambda x, i: F.concat(F.get(F.col(rest), i), pseudonym(key, F.get(F.col(kinds), i), x)))
    new = F.when(F.size(hits) > 0, F.concat(F.array_join(parts, ""), F.element_at(F.col(rest), -1))).otherwise(whole)
    out = some.withColumn(text, new)
    if found:
        out = out.withColumn(found, F.filter(F.coalesce(F.col(kinds), none), lambda x: x.isNotNull()))
    return out.drop(hits, kinds, rest)


def replaced(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, text with pseudonyms (null: empty), and how many values of each kind were replaced."""
    found = with_pseudonyms(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), key, found="found")

    def count(kind: str) -> Column:
        return F.size(F.filter(F.col("found"), lambda x: x == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", "text", *map(count, PATTERNS))
