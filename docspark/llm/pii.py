"""Format-preserving pseudonyms for personal numbers and dates, by keyed Feistel networks.

Found numbers are validated (Luhn, mod 97, octets, calendar, area codes) and permuted within their own format: a card
number becomes another valid card number, a date another date in the same notation. Separators take no part: they are
set aside and put back. So equal values get equal pseudonyms in every document and notation, different ones stay
different. Everything is an expression over the row; nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.staging import table

KEY = "docspark"  # for tests and the registered query: anybody can undo what this one does
KEY_SETTING = "spark.docspark.pii.key"
KINDS = ("email", "ip", "phone", "card", "ssn", "iban", "date")
# fixed values: the notations looked for
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])",
    "date": r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<!\d)(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\) ?\d{3}-\d{4}|(?<![\d.-])(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?![.-]?\d))(?!\d)",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
}
ANY = "|".join(PATTERNS.values())
MAYBE = r"\d[ .-]?\d|@"  # in every match of ANY; cheap to rule texts out by
# fixed values: country codes of the international numbering plan with one and two digits; all others have three
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
DAYS = 146097  # of 400 years, 189 * 773
FIRST_DAY = "1800-01-01"


def _prf(key: str | Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key) if isinstance(key, str) else key, *(p.cast("string") for p in parts)), 256)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def permute_number(value: Column, a: int, b: int, key: str, rounds: int = 6) -> Column:
    """A keyed permutation of 0 .. a*b-1: a Feistel network over the pair (value div b, value mod b)."""
    start = F.struct((F.floor(value / b)).cast("long").alias("x"), F.pmod(value, F.lit(b)).cast("long").alias("y"))

    def step(s: Column, k: Column) -> Column:
        x = F.pmod(s["x"] + _number(_prf(key, k, s["y"])), F.lit(a))
        y = F.pmod(s["y"] + _number(_prf(key, k, s["x"])), F.lit(b))
        odd = k % 2 == 1
        return F.struct(F.when(odd, x).otherwise(s["x"]).cast("long").alias("x"), F.when(odd, s["y"]).otherwise(y).cast("long").alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: s["x"] * b + s["y"])


def permute_characters(text: Column, key: str | Column, rounds: int = 4) -> Column:
    """A keyed permutation of the strings with the same digits, capitals, small letters and other characters in the same
    places: each half is shifted, character by character, by what the other half gives."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))

    def step(s: Column, k: Column) -> Column:
        digest = _prf(key, k, s["r"])

        def shift(c: Column, j: Column) -> Column:
            by = F.conv(F.substring(digest, F.pmod(j, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            turn = lambda base, n: F.char(F.lit(base) + F.pmod(F.ascii(c) - base + by, F.lit(n)))
            return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).otherwise(c)

        return F.struct(s["r"].alias("l"), F.array_join(F.transform(F.split(s["l"], ""), shift), "").alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: F.concat(s["l"], s["r"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def refilled(text: Column, new: Column, other: str = r"\D") -> Column:
    """`text` with its characters, but those that match `other`, replaced by those of `new` in turn."""

    def place(c: Column, i: Column) -> Column:
        return F.when(c.rlike(other), c).otherwise(F.substring(new, F.length(F.regexp_replace(F.substring(text, F.lit(1), i + 1), other, "")), F.lit(1)))

    return F.array_join(F.transform(F.split(text, ""), place), "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum; the last digit counts double if `doubled` is 0, the one before it if 1."""

    def weigh(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == doubled, n * 2 - F.when(n > 4, 9).otherwise(0)).otherwise(n)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weigh), F.lit(0), lambda s, n: s + F.coalesce(n, F.lit(0)))


def _card(x: Column, key: str) -> tuple[Column, Column]:
    digits = _digits(x)
    body = F.concat(F.substring(digits, 1, 1), permute_characters(F.substring(digits, F.lit(2), F.length(digits) - 2), key))
    check = F.pmod(F.lit(10) - luhn_sum(body, 0) % 10, F.lit(10))
    return luhn_sum(digits, 1) % 10 == 0, refilled(x, F.concat(body, check.cast("string")))


def mod97(text: Column) -> Column:
    """Of a number written with letters for 10..35."""

    def add(s: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (s * 10 + F.ascii(c) - 48) % 97).when(c.between("A", "Z"), (s * 100 + F.ascii(c) - 55) % 97).otherwise(s).cast("int")

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _iban(x: Column, key: str) -> tuple[Column, Column]:
    """Of a spaced one the longest valid run of groups, as words in capitals may follow."""
    plain = lambda n: F.translate(F.substring(x, F.lit(1), n), " ", "")
    valid = lambda n: (F.length(plain(n)) >= 15) & (mod97(F.concat(F.substring(plain(n), F.lit(5), F.length(x)), F.substring(plain(n), 1, 4))) == 1)
    ends = F.filter(F.sequence(F.lit(15), F.greatest(F.length(x), F.lit(15))), lambda n: ((n == F.length(x)) | (F.substring(x, n + 1, F.lit(1)) == " ")) & valid(n))
    end = F.array_max(ends)
    country, rest = F.substring(x, 1, 2), F.substring(plain(end), F.lit(5), F.length(x))
    new = permute_characters(rest, key)
    check = F.lpad((F.lit(98) - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    return F.coalesce(F.size(ends) > 0, F.lit(False)), F.concat(refilled(F.substring(x, F.lit(1), end), F.concat(country, check, new), " "), F.substring(x, end + 1, F.length(x)))


def _ip(x: Column, key: str) -> tuple[Column, Column]:
    octets = F.transform(F.split(x, r"\."), lambda o: o.cast("long"))
    n = permute_number(F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o), 65536, 65536, key)
    out = F.concat_ws(".", *((F.shiftright(n, k) % 256).cast("string") for k in (24, 16, 8, 0)))
    return F.forall(octets, lambda o: o <= 255), out


def _ssn(x: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.element_at(F.split(x, "-"), k).cast("long") for k in (1, 2, 3))
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    n = permute_number((place * 99 + group - 1) * 9999 + serial - 1, 898, 99 * 9999, key)
    new = F.floor(n / (99 * 9999)) + 1
    new = new + F.when(new >= 666, 1).otherwise(0)
    out = F.format_string("%03d-%02d-%04d", new.cast("long"), (F.floor(n / 9999) % 99 + 1).cast("long"), (n % 9999 + 1).cast("long"))
    return area.between(1, 899) & (area != 666) & (group >= 1) & (serial >= 1), out


def _date(x: Column, key: str) -> tuple[Column, Column]:
    """ISO, then day before month, then month before day, whichever is a calendar date of 1800 to 2199."""
    iso = F.substring(x, 5, 1) == "-"
    mark = F.when(F.substring(x, 3, 1) == "/", "/").otherwise(".")
    dashed = F.translate(x, "./", "--")
    valid, out = F.lit(False), F.lit(None).cast("string")
    for pattern in ("MM-dd-yyyy", "dd-MM-yyyy", "yyyy-MM-dd"):
        day = F.datediff(F.try_to_timestamp(dashed, F.lit(pattern)).cast("date"), F.lit(FIRST_DAY).cast("date"))
        ok = F.coalesce((iso if pattern[0] == "y" else ~iso) & day.between(0, DAYS - 1), F.lit(False))
        new = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), permute_number(day, 189, 773, key).cast("int")), pattern)
        out = F.when(ok, new if pattern[0] == "y" else F.array_join(F.split(new, "-"), "/")).otherwise(out)
        valid = valid | ok
    return valid, F.when(~iso & (mark == "."), F.translate(out, "/", ".")).otherwise(out)


def _email(x: Column, key: str) -> tuple[Column, Column]:
    return F.lit(True), F.concat(permute_characters(F.substring_index(x, "@", 1), key), F.lit("@"), F.substring_index(x, "@", -1))


def _phone(x: Column, key: str) -> tuple[Column, Column]:
    """The country code stays; a number without one is written as in the numbering plan of code 1."""
    digits = _digits(x)
    code = F.when(x.startswith("+"), F.regexp_extract(digits, COUNTRY, 0)).otherwise("")
    own = F.substring(digits, F.length(code) + 1, F.length(x))
    keyed = F.concat(F.lit(f"{key}|"), F.when(code == "", "1").otherwise(code))
    return F.length(digits).between(8, 15), refilled(x, F.concat(code, permute_characters(own, keyed)))


RULES = {"email": _email, "ip": _ip, "phone": _phone, "card": _card, "ssn": _ssn, "iban": _iban, "date": _date}


def pseudonym(x: Column, key: str = KEY) -> Column:
    """struct(kind, value) of a found string; a null kind and the string itself if no rule validates it."""
    out = F.struct(F.lit(None).cast("string").alias("kind"), x.alias("value"))
    for kind in reversed(KINDS):
        valid, new = RULES[kind](x, f"{key}|{kind}")
        out = F.when(x.rlike(f"^(?:{PATTERNS[kind]})$") & valid, F.struct(F.lit(kind).alias("kind"), new.alias("value"))).otherwise(out)
    return out


def own_key(spark: SparkSession) -> str:
    key = spark.conf.get(KEY_SETTING, None)
    if not key and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError(f"{KEY_SETTING} must hold a key: pseudonyms by a published one can be undone")
    return key or KEY


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """One row per row: doc_id, text with pseudonyms, and n_<kind> for each of KINDS.

    Where notations overlap, the leftmost match wins, then the order of PATTERNS. A string that looks like a kind but is
    not valid stays as it is, and so do names, postal addresses, the domains of mail addresses and the country codes of
    phone numbers. The key is that of KEY_SETTING in the session if none is given; without either a local session, as in
    tests, takes KEY, and a cluster is refused. A local part of one letter is shifted by a keyed amount. Null texts stay null and count
    nothing; long texts are read whole; repeated rows get the same result; ids may be null; other columns are ignored."""
    key = key or own_key(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    some = F.coalesce(F.col("text").rlike(MAYBE), F.lit(False)) & F.coalesce(F.col("text").rlike(ANY), F.lit(False))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    found = read.withColumn("hit", some)
    found = found.withColumn("new", F.when(F.col("hit"), F.transform(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), lambda x: pseudonym(x, key))).otherwise(none))
    gaps = F.split("text", ANY, -1)
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get("new", i)["value"], F.lit("")))), "")
    counts = [F.size(F.filter("new", lambda x: x["kind"] == kind)).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", F.when(F.col("hit"), joined).otherwise(F.col("text")).alias("text"), *counts)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), key=spark.conf.get(KEY_SETTING, KEY))
