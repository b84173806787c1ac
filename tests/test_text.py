from datetime import date

from rebill.functions import text


def values(spark, f, *cells):
    return [r[0] for r in spark.createDataFrame([(c,) for c in cells], "x string").select(f("x")).collect()]


def test_dates(spark):
    got = values(spark, text.parse_date, "2026-08-05", "05.08.2026", "5/8/2026", "05.08.26", "05.08.75", "31.02.2026", "x", None)
    assert got == [date(2026, 8, 5)] * 4 + [date(1975, 8, 5), None, None, None]


def test_amounts(spark):
    assert values(spark, text.parse_amount, "-599,00 ₽", "5 480,00", "1,000.00", "599", "", None) == [-599.0, 5480.0, None, 599.0, None, None]


def test_headers(spark):
    assert values(spark, text.norm_header, "Сумма (руб);", " Счёт  №1 ") == ["сумма", "счет 1"]
