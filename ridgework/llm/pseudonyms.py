"""Format-preserving Feistel pseudonyms of personal data, in DataFrame operations only.

One regular expression finds candidates; each is validated (Luhn digits of card numbers, octets of
addresses, calendar days, ranges of social security numbers, digits of phone numbers) and then replaced by
a keyed permutation within its format.  A permutation maps equal values to equal pseudonyms, so they
stay linked across documents, and different ones to different.  What doesn't validate stays as it is.

=====  =========================================  ============================================
kind   found as                                   what is permuted
=====  =========================================  ============================================
email  local part, ``@``, domain                  letters and digits within their class, all but the top-level domain
ip     four octets up to 255                      the 32-bit number
date   yyyy-mm-dd, dd/mm/yyyy, dd.mm.yyyy         days of 1900 to 2099
ssn    ddd-dd-dddd with area, group, serial       the valid numbers
phone  +country code or (area) or ddd-ddd-dddd    digits after the country code
card   13 to 19 digits, in groups or not, Luhn    all digits but the last, which makes the Luhn sum right
=====  =========================================  ============================================
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import permuted, table

#: The session's setting that holds the key.
KEY_SETTING = "spark.ridgework.pseudonyms.key"
KINDS = ("email", "ip", "date", "ssn", "phone", "card")
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9\-])"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
DATE = r"(?<![\d./\-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/\-]|\.\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}[.\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\d|[.\-]\d)"
CARD = r"(?<![\d.\-+])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){2,3}(?:[ \-]\d{1,3})?|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d|[.\-]\d)"
#: All but e-mail addresses start with one of four kinds of character, which is tested once for them all.
CANDIDATE = rf"{EMAIL}|(?=[0-9+(])(?:{'|'.join((IP, DATE, SSN, PHONE, CARD))})"
#: Days from FIRST_DAY on that dates are permuted within, and valid social security numbers.
FIRST_DAY, DAYS = "1900-01-01", 73049
AREAS, GROUPS, SERIALS = 898, 99, 9999


def _let(value: Column, f) -> Column:
    """f(value), with value evaluated once however often f uses it: lambda variables hold values, columns are evaluated at every use."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _hex(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts)), 256)


def _number(digits: Column) -> Column:
    return digits.try_cast("long")


def _permute(value: Column, n, key: str, kind: str) -> Column:
    """A permutation of 0..n-1 by SHA-256 of key, kind, round and half."""
    prf = lambda r, half: F.conv(F.substring(_hex(f"{key}|{kind}|{r}", half), 1, 15), 16, 10).try_cast("long")
    return permuted(value, n if isinstance(n, Column) else F.lit(n).cast("long"), prf, _let)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _refill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, in order, by those given (0-9, as many)."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))

    def fill(digits: Column) -> Column:
        def put(acc: Column, c: Column) -> Column:
            digit = c.between("0", "9")
            return F.struct(F.concat(acc["out"], F.when(digit, F.substr(digits, acc["i"], F.lit(1))).otherwise(c)).alias("out"), (acc["i"] + digit.cast("int")).alias("i"))

        return F.aggregate(F.split(template, ""), start, put, lambda acc: acc["out"])

    return _let(digits, fill)


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits of a string where every second from the last on counts twice, by its digits."""

    def add(acc: Column, c: Column, i: Column) -> Column:
        d = c.try_cast("int") * (1 + F.pmod(i, F.lit(2)))
        return acc + F.when(d > 9, d - 9).otherwise(d)

    pairs = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.aggregate(pairs, F.lit(0), lambda acc, x: add(acc, x["c"], x["i"]))


def _email(value: Column, key: str) -> Column:
    """A Feistel network on the characters before the top-level domain: each half shifts the other's letters and digits."""
    top = F.regexp_extract(value, r"\.[A-Za-z]+$", 0)
    body = F.substr(value, F.lit(1), F.length(value) - F.length(top))
    half = F.floor(F.length(body) / 2).cast("int")
    left, right = F.substr(body, F.lit(1), half), F.substr(body, half + 1)

    def shift(part: Column, stream: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            k = F.conv(F.substr(stream, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).try_cast("int")
            move = lambda base, n: F.char(F.lit(base) + F.pmod(F.ascii(c) - base + k, F.lit(n)))
            return F.when(c.between("0", "9"), move(48, 10)).when(c.between("a", "z"), move(97, 26)).when(c.between("A", "Z"), move(65, 26)).otherwise(c)

        return F.array_join(F.transform(F.split(part, ""), one), "")

    def rounds(left: Column, right: Column, r: int) -> Column:
        if r == 4:
            return F.concat(left, right, top)
        if r % 2 == 0:
            return _let(_hex(f"{key}|email|{r}", right), lambda k: _let(shift(left, k), lambda x: rounds(x, right, r + 1)))
        return _let(_hex(f"{key}|email|{r}", left), lambda k: _let(shift(right, k), lambda x: rounds(left, x, r + 1)))

    return _let(left, lambda left: _let(right, lambda right: rounds(left, right, 0)))


def _ip(value: Column, key: str) -> Column:
    n = F.aggregate(F.split(value, r"\."), F.lit(0).cast("long"), lambda acc, o: acc * 256 + o.try_cast("long"))
    return _let(_permute(n, 1 << 32, key, "ip"), lambda x: F.concat_ws(".", *(F.shiftright(x, s).bitwiseAND(F.lit(255)) for s in (24, 16, 8, 0))))


def _iso(value: Column) -> Column:
    """yyyy-mm-dd of a date in one of its formats."""
    return F.when(F.substring(value, 5, 1) == "-", value).otherwise(F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2)))


def _day(value: Column) -> Column:
    """Days since FIRST_DAY, null if it is no day of the calendar."""
    return F.datediff(F.try_to_timestamp(_iso(value), F.lit("yyyy-MM-dd")).cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")


def _date(value: Column, key: str) -> Column:
    d = F.date_add(F.lit(FIRST_DAY).cast("date"), _permute(_day(value), DAYS, key, "date").cast("int"))
    form = lambda d: F.when(F.substring(value, 5, 1) == "-", F.date_format(d, "yyyy-MM-dd")).when(F.substring(value, 3, 1) == "/", F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "dd.MM.yyyy"))
    return _let(d, form)


def _ssn_parts(value: Column) -> tuple[Column, Column, Column]:
    return F.substring(value, 1, 3).try_cast("long"), F.substring(value, 5, 2).try_cast("long"), F.substring(value, 8, 4).try_cast("long")


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = _ssn_parts(value)
    n = ((area - 1 - (area > 666).cast("long")) * GROUPS + group - 1) * SERIALS + serial - 1

    def write(x: Column) -> Column:
        serial, x = F.pmod(x, F.lit(SERIALS)) + 1, F.floor(x / SERIALS)
        group, area = F.pmod(x, F.lit(GROUPS)) + 1, F.floor(x / GROUPS) + 1
        return F.concat_ws("-", F.lpad((area + (area > 665).cast("long")).cast("string"), 3, "0"), F.lpad(group.cast("string"), 2, "0"), F.lpad(serial.cast("string"), 4, "0"))

    return _let(_permute(n, AREAS * GROUPS * SERIALS, key, "ssn"), write)


def _phone(value: Column, key: str) -> Column:
    code = F.regexp_extract(value, r"^\+\d{1,3}(?=\D)", 0)
    rest = F.substr(value, F.length(code) + 1)
    digits = _digits(rest)
    size = F.length(digits)
    x = _permute(_number(digits), F.pow(F.lit(10.0), size).try_cast("long"), key, "phone")
    return F.concat(code, _refill(rest, F.lpad(x.cast("string"), size, "0")))


def _card(value: Column, key: str) -> Column:
    digits = _digits(value)
    size = F.length(digits) - 1
    x = F.lpad(_permute(_number(F.substr(digits, F.lit(1), size)), F.pow(F.lit(10.0), size).try_cast("long"), key, "card").cast("string"), size, "0")
    check = lambda x: F.pmod(10 - F.pmod(luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)), F.lit(10))
    return _refill(value, _let(x, lambda x: F.concat(x, check(x).cast("string"))))


def kind_of(value: Column) -> Column:
    """The kind that a candidate validates as, null if none."""
    digits = _digits(value)
    n = F.length(digits)
    area, group, serial = _ssn_parts(value)
    octets = F.split(value, r"\.")
    return (
        F.when(F.contains(value, F.lit("@")), "email")
        .when(value.rlike(rf"^{IP}$"), F.when(F.forall(octets, lambda o: o.try_cast("int") <= 255), "ip"))
        .when(value.rlike(rf"^{DATE}$"), F.when(_day(value).between(0, DAYS - 1), "date"))
        .when(value.rlike(rf"^{SSN}$"), F.when((area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), "ssn"))
        .when(value.rlike(rf"^(?:{PHONE})$") & n.between(8, 15), "phone")
        .when(value.rlike(rf"^{CARD}$") & n.between(13, 19), F.when((F.pmod(luhn_sum(digits), F.lit(10)) == 0) & (F.regexp_replace(digits, "0", "") != ""), "card"))
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    out = F.when(kind == "email", _email(value, key)).when(kind == "ip", _ip(value, key)).when(kind == "date", _date(value, key))
    return out.when(kind == "ssn", _ssn(value, key)).when(kind == "phone", _phone(value, key)).when(kind == "card", _card(value, key)).otherwise(value)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_<kind> per kind: a row per row of ``docs``.

    Null texts stay null and empty ones empty, with counts of 0; rows are independent, so repeated rows
    give repeated results; columns other than doc_id and text don't matter.  Texts are processed whole.
    Who has the key can invert the pseudonyms, so it is no default of the code; it must not be empty.
    """
    if not key:
        raise ValueError("a key is needed")
    # every candidate holds a digit or an @, which most texts don't: a cheap test spares them the long expression
    all_found = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    found = docs.select("doc_id", "text", F.when(F.col("text").rlike("[0-9@]"), all_found).otherwise(F.array().cast("array<string>")).alias("_found"))
    some = F.size("_found") > 0
    found = found.withColumn("_kinds", F.when(some, F.transform("_found", kind_of)))
    new = F.zip_with("_found", "_kinds", lambda v, k: pseudonym(v, k, key))
    between = F.split("text", CANDIDATE, -1)  # one more than candidates
    text = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    counts = [F.when(some, F.size(F.filter("_kinds", F.lit(kind).__eq__))).otherwise(0).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", F.when(some, text).otherwise(F.col("text")).alias("text"), *counts)


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, under the session's key, or under one of this run alone where none is set."""
    return pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, None) or secrets.token_hex(16))
