"""Scalar functions on known values."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgermesh.functions import scalars as S


def values(spark, texts, make):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r.v for r in rows.select("i", make("s").alias("v")).orderBy("i").collect()]


CARD = "a13049c9f1874327b8a1257ee553f0a9"


def test_hashes(spark):
    assert values(spark, ["", "abc", CARD, None], S.bkdr_hash) == [0, 1677554, 38387626765, None]
    assert values(spark, ["", "abc", CARD, None], S.md5_long) == [785164969033090, 134153845407886, 795594688173232, None]
    assert values(spark, ["x", None], S.hmac_long) == [768053806484449] * 2


def test_hashes_equal_plain_definitions(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcXYZ019 -中文é", k=rng.randint(0, 40))) for _ in range(300)]

    def bkdr(s):
        h = 0
        for ch in s:
            h = (h * 131 + ord(ch)) & 0x1FFFFFFFFF
        return h

    md5 = lambda s: int(str(abs(int.from_bytes(hashlib.md5(s.encode()).digest(), "big", signed=True)))[-15:])
    assert values(spark, texts, S.bkdr_hash) == [bkdr(t) for t in texts]
    assert values(spark, texts, S.md5_long) == [md5(t) for t in texts]


def test_days(spark):
    assert values(spark, ["20161001", "20161002", "nonsense", None], S.day_of_week) == [6, 7, None, None]
    assert values(spark, ["20160701", "20161231", None], S.day_number) == [1, 184, None]
    rows = spark.range(1, 185).select(S.day_number(S.day_of_number("id")).alias("n"))
    assert sorted(r.n for r in rows.collect()) == list(range(1, 185))


@pytest.mark.parametrize("unit, wanted", [("seconds", 3661.0), ("mins", 3661 / 60), ("hours", 3661 / 3600)])
def test_delta_time(spark, unit, wanted):
    rows = spark.createDataFrame([("1001000000", "1001010101"), ("bad", "1001010101"), ("0229000000", "0301000000"), ("1332000000", "0201007501")], "a string, b string")
    got = [r.v for r in rows.select(S.delta_time("a", "b", unit).alias("v")).collect()]
    assert got[3] * {"seconds": 1, "mins": 60, "hours": 3600}[unit] == pytest.approx(-365 * 86_400 + 75 * 60 + 1)  # 1332: the 32nd of the next January
    assert got[0] == pytest.approx(wanted) and math.isnan(got[1]) and got[2] == 0.0  # 29 February rolls over in a year of 28
    with pytest.raises(ValueError):
        S.delta_time("a", "b", "weeks")


def test_codes_and_fills(spark):
    assert values(spark, ["12345678", "1234", "", None], S.bank_code) == ["1234", "1234", "", None]
    assert values(spark, ["12345678", "1234", "", None], S.region_code) == ["5678", "1234", "", None]
    assert values(spark, ["", "x", None], S.fill_empty) == ["NANs", "x", None]
    assert values(spark, ["", None], lambda c: S.fill_empty(c, nulls=True)) == ["NANs", "NANs"]
    assert values(spark, ["39", "38"], S.high_risk_location) == [True, False]
    assert values(spark, ["5732", "4111", "1"], S.category_risk) == ["high", "low", "normal"]
    assert values(spark, ["a", "b"], lambda c: S.listed(c, ["b"])) == [False, True]
    assert values(spark, ["a,b,,", "", ",", "a"], lambda c: S.split_trimmed(c, ",")) == [["a", "b"], [""], [], ["a"]]


def test_doubles_as_doubles(spark):
    row = spark.range(1).select(
        S.ratio(F.lit(0), F.lit(0)).alias("nan"), S.ratio(F.lit(1), F.lit(0)).alias("inf"), S.ratio(F.lit(-1), F.lit(0)).alias("low"), S.min_max(F.lit(3), F.lit(1), F.lit(5)).alias("half"), S.z_score(F.lit(3), F.lit(1), F.lit(4)).alias("z"), S.natural_log(F.lit(0.0)).alias("ln0"), S.natural_log(F.lit(-1.0)).alias("ln")
    ).first()
    assert math.isnan(row.nan) and row.inf == math.inf and row.low == -math.inf and row.half == row.z == 0.5 and row.ln0 == -math.inf and math.isnan(row.ln)


def test_joined_row_writes_nulls(spark):
    assert spark.createDataFrame([(1, None, "x")], "a int, b string, c string").select(S.joined_row("a", "b", "c").alias("v")).first().v == "1,null,x"
