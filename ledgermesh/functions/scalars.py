"""Scalar functions of the payment pipelines, all from built-in expressions.

Each takes a column (or its name) and returns a Column. Null in, null out, unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flags for locations and merchant categories.
HIGH_RISK_LOCATIONS = ("39", "40", "41", "42", "43", "44", "64")
LOW_RISK_CATEGORIES = "3999 4111 4899 5309 5960 6012 6051 6300 6513 8011 8043 8062 8099 8211 8220 8398 8888 9311 9399".split()
HIGH_RISK_CATEGORIES = "4214 4511 5065 5094 5211 5251 5310 5331 5533 5712 5722 5732 5932 5947 5993 7221".split()

#: What an empty string is filled with.
EMPTY = "NANs"
#: Value of the keyed hash whose key and message are one constant.
HMAC_CONSTANT = 768053806484449
#: The day before day number 1.
DAY_ZERO = "2016-06-30"

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bkdr_hash(text: ColumnOrName) -> Column:
    """131-multiplier string hash kept to 37 bits, over UTF-16 units: a character beyond the basic plane counts as its two surrogates."""

    def add(h: Column, unit: Column) -> Column:
        return (h * 131 + unit).bitwiseAND(F.lit((1 << 37) - 1))

    def step(h: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        pair = add(add(h, F.lit(0xD800) + F.shiftright(code - 0x10000, 10)), F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF)))
        return F.when(code >= 0x10000, pair).otherwise(add(h, code))

    return F.aggregate(F.split(_c(text), ""), F.lit(0).cast("long"), step)


def md5_long(text: ColumnOrName) -> Column:
    """The MD5 digest as a signed big-endian integer, without its sign and modulo 10**15."""
    return _digest_long(F.md5(_c(text).cast("binary")))


def _digest_long(digest: Column) -> Column:
    wide = lambda n: F.lit(n).cast("decimal(20,0)")
    rest = wide(0)
    for i in range(4):
        part = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
        rest = ((rest * F.lit(1 << 32).cast("decimal(10,0)") + part) % wide(10**15)).cast("decimal(20,0)")
    negative = F.substring(digest, 1, 1) >= "8"
    return F.when(negative, (wide((1 << 128) % 10**15 + 10**15) - rest) % wide(10**15)).otherwise(rest).cast("long")


def hmac_long(text: ColumnOrName) -> Column:
    """The keyed hash of a constant: the same for every text, nulls included. keyed_hash() hashes its argument."""
    return F.lit(HMAC_CONSTANT).cast("long")


def _pad(key: Column, byte: int) -> Column:
    """The key, as binary, filled with zeros up to 64 bytes, each byte xor the given one, digit by digit of its hex form."""
    digits = "0123456789ABCDEF"
    mixed = lambda half, by: F.translate(half, digits, "".join(digits[i ^ by] for i in range(16)))
    text = F.rpad(F.hex(key), 128, "0")
    high, low = mixed(F.regexp_replace(text, "(.).", "$1"), byte >> 4), mixed(F.regexp_replace(text, ".(.)", "$1"), byte & 15)
    return F.unhex(F.array_join(F.zip_with(F.split(high, ""), F.split(low, ""), lambda a, b: F.concat(a, b)), ""))


def hmac_md5(text: ColumnOrName, key: ColumnOrName | bytes) -> Column:
    """The HMAC-MD5 digest of a text as hex: two padded MD5 passes. A key of more than 64 bytes is hashed first. Null in either, null out."""
    message = _c(text).cast("binary")
    secret = F.lit(key) if isinstance(key, bytes) else _c(key).cast("binary")
    short = F.when(F.octet_length(secret) > 64, F.unhex(F.md5(secret))).otherwise(secret)
    inner = F.unhex(F.md5(F.concat(_pad(short, 0x36), message)))
    return F.md5(F.concat(_pad(short, 0x5C), inner))


def keyed_hash(text: ColumnOrName, key: ColumnOrName | bytes) -> Column:
    """The HMAC-MD5 of a text as a signed big-endian integer, without its sign and modulo 10**15."""
    return F.get(F.transform(F.array(hmac_md5(text, key)), _digest_long), F.lit(0))  # the digest is computed once


def day_of_week(day: ColumnOrName) -> Column:
    """1 (Monday) to 7 (Sunday) of a yyyyMMdd string; null for what is no day."""
    return F.weekday(F.try_to_timestamp(_c(day), F.lit("yyyyMMdd"))) + 1


def delta_time(start: ColumnOrName, end: ColumnOrName, unit: str = "seconds") -> Column:
    """Time from start to end, both MMddHHmmss without a year, in seconds, mins or hours; NaN for what isn't ten digits.

    Fields beyond their range roll over, as a lenient reader has it: month 13 is the next January, minute 75 the next hour's 15.
    """
    per = {"seconds": 1.0, "mins": 60.0, "hours": 3600.0}
    if unit not in per:
        raise ValueError(f"unit {unit!r} is none of {sorted(per)}")

    def at(c: ColumnOrName) -> Column:
        month, day, hour, minute, second = (F.substring(_c(c), 2 * i + 1, 2).try_cast("int") for i in range(5))
        days = F.unix_date(F.add_months(F.to_date(F.lit("1970-01-01")), month - 1)) + day - 1
        return F.when(F.rlike(_c(c), F.lit("^[0-9]{10}$")), days.cast("long") * 86_400 + hour * 3_600 + minute * 60 + second)

    return F.coalesce((at(end) - at(start)) / F.lit(per[unit]), F.lit(float("nan")))


def bank_code(code: ColumnOrName) -> Column:
    """First four characters of an 8-character institution code, any other code whole."""
    c = _c(code)
    return F.when(F.length(c) == 8, F.substring(c, 1, 4)).otherwise(c)


def region_code(code: ColumnOrName) -> Column:
    """Last four characters of an 8-character institution code, any other code whole."""
    c = _c(code)
    return F.when(F.length(c) == 8, F.substring(c, 5, 4)).otherwise(c)


def fill_empty(value: ColumnOrName, fill: str = EMPTY, nulls: bool = False) -> Column:
    """`fill` for an empty string, and for null if `nulls`."""
    c = _c(value)
    return F.when(c == "", F.lit(fill)).otherwise(F.coalesce(c, F.lit(fill)) if nulls else c)


def day_number(day: ColumnOrName) -> Column:
    """1 for 20160701, 2 for the next day, and so on."""
    return F.datediff(F.to_date(F.try_to_timestamp(_c(day), F.lit("yyyyMMdd"))), F.to_date(F.lit(DAY_ZERO)))


def day_of_number(number: ColumnOrName) -> Column:
    """The yyyyMMdd string of a day number."""
    return F.date_format(F.date_add(F.to_date(F.lit(DAY_ZERO)), _c(number).cast("int")), "yyyyMMdd")


def ratio(x: Column, y: Column) -> Column:
    """x / y as doubles divide: 0 / 0 is NaN, and others by 0 are infinite."""
    x, y = x.cast("double"), y.cast("double")
    zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(y == 0, zero).otherwise(F.try_divide(x, y))


def min_max(x: ColumnOrName, low: Column, high: Column) -> Column:
    """(x - low) / (high - low); NaN for 0 / 0."""
    return ratio(_c(x) - low, high - low)


def z_score(x: ColumnOrName, mean: Column, deviation: Column) -> Column:
    return ratio(_c(x) - mean, deviation)


def natural_log(x: Column) -> Column:
    """ln with -infinity at 0 and NaN below, as doubles have it."""
    return F.when(x == 0, F.lit(float("-inf"))).when((x < 0) | F.isnan(x), F.lit(float("nan"))).otherwise(F.ln(x))


def split_trimmed(text: ColumnOrName, pattern: str) -> Column:
    """Parts between matches of the pattern, without the empty ones at the end (but one part at least)."""
    parts = F.split(_c(text), pattern)
    last = F.aggregate(F.transform(parts, lambda p, i: F.when(p != "", i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    return F.when(F.size(parts) == 1, parts).otherwise(F.slice(parts, 1, F.greatest(last, F.lit(0))))


def joined_row(*columns: ColumnOrName, sep: str = ",") -> Column:
    """The values as one line; null is written as the word null."""
    return F.concat_ws(sep, *(F.coalesce(_c(c).cast("string"), F.lit("null")) for c in columns))


def high_risk_location(code: ColumnOrName) -> Column:
    return _c(code).isin(*HIGH_RISK_LOCATIONS)


def category_risk(code: ColumnOrName) -> Column:
    """'high', 'low' or 'normal' for a merchant category."""
    c = _c(code)
    return F.when(c.isin(*HIGH_RISK_CATEGORIES), "high").when(c.isin(*LOW_RISK_CATEGORIES), "low").otherwise("normal")


def listed(code: ColumnOrName, codes: list[str]) -> Column:
    """Whether a merchant is on a given risk list."""
    return _c(code).isin(*codes)
