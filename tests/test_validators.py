import pytest
from pyspark.sql import functions as F

from taxloom.functions import validators as v


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_abn(spark):
    good = ["88000014675", "64067190363", "61291347325", "88 000 014 675"]
    bad = ["12345", "123456789012", "abc123def456", "88 000 014 999", "", None, "51 004 085 616", "63 000 240 417"]
    got = values(spark, [(x,) for x in good + bad], "abn string", v.abn_issue(F.col("abn")).isNull())
    assert [x for (x,) in got] == [True] * len(good) + [False] * len(bad)
    assert values(spark, [("88000014675",)], "abn string", v.abn_format(F.col("abn"))) == [("88 000 014 675",)]


def test_gst(spark):
    rows = [(100.0, 10.0, 110.0, True), (45.45, 4.55, 50.0, True), (23.63, 2.36, 25.99, True), (100.0, 5.0, 105.0, False), (100.0, 10.0, 115.0, False), (100.0, 0.0, 100.0, True)]
    got = values(spark, rows, "s double, g double, t double, want boolean", v.gst_valid(F.col("s"), F.col("g"), F.col("t")), F.col("want"))
    assert all(a == b for a, b in got)
    rows = [(23.64, 2.36, 26.0, True), (100.0, 10.01, 110.01, False)]
    got = values(spark, rows, "s double, g double, t double, want boolean", v.gst_rounded(F.col("s"), F.col("g"), F.col("t")), F.col("want"))
    assert all(a == b for a, b in got)


def test_dates(spark):
    good = ["25/03/2024", "1/1/2024", "29/02/2024", "25-03-2024", "25 Mar 2024", "25 March 2024", "25.03.2024"]
    bad = ["2024/03/25", "2024-03-25", "25/13/2024", "32/03/2024", "29/02/2023", "invalid", "", None]
    got = values(spark, [(x,) for x in good + bad], "t string", v.date_issue(F.col("t"), 2024).isNull())
    assert [x for (x,) in got] == [True] * len(good) + [False] * len(bad)
    got = values(spark, [("30/06/2024",), ("01/07/2024",), ("5/4/99",)], "t string", v.financial_year(v.parse_date(F.col("t"))))
    assert got == [("2023-2024",), ("2024-2025",), ("1998-1999",)]


def test_amounts(spark):
    rows = [("$45.67", 45.67), ("1,234.56", 1234.56), ("$10", 10.0), ("$45.6789", None), ("45..67", None), ("$-45.67", None), ("abc", None), ("$1,23.45", None)]
    assert values(spark, rows, "t string, want double", v.amount_value(F.col("t")), F.col("want")) == [(w, w) for _, w in rows]


@pytest.mark.parametrize("bsb,bank", [("632456", "Bendigo Bank"), ("642456", "Suncorp"), ("182456", "Macquarie"), ("923456", "ING"), ("735000", "Commonwealth Bank"), ("342000", "Westpac"), ("123456", None)])
def test_banks(spark, bsb, bank):
    assert values(spark, [(bsb,)], "b string", v.bank_of(v.bsb_prefix(F.col("b")))) == [(bank,)]


def test_bsb_format(spark):
    rows = [("123456", "123-456"), ("12 34 56", "123-456"), ("12345", "12345")]
    assert values(spark, rows, "b string, want string", v.bsb_format(F.col("b")), F.col("want")) == [(w, w) for _, w in rows]
