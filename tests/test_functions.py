from datetime import date

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillbook.functions import dates as D
from quillbook.functions import numbers as N
from quillbook.functions import text as T


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, s {kind}")
    return [r[0] for r in df.select("i", f(F.col("s")).alias("x")).orderBy("i").select("x").collect()]


def test_to_float_is_zero_where_parse_amount_is_null(spark):
    values = ["1,234.50", "(1,234.50)", "₹ 12,000 Dr", "-5", "abc", "5d", "nan", "n/a", None, "A\n12", "1e3"]
    assert column(spark, values, N.to_float) == [1234.5, 0, 0, -5, 0, 0, 0, 0, 0, 12, 1000]
    assert column(spark, values, N.parse_amount) == [1234.5, -1234.5, 12000, -5, None, 5, None, None, None, 12, 1]


def test_balances_get_their_sign_from_dr_cr_or_the_kind_of_account(spark):
    sign = lambda debt: column(spark, ["10 Dr", "10 Cr", "10"], lambda c: N.signed_balance(c, F.lit(""), F.lit(debt)))
    assert sign(False) == [-10, 10, 10]
    assert sign(True) == [-10, 10, -10]


def test_dates(spark):
    forms = ["05 Sep 2025", "5-SEP-2025", "31/12/2024", "12/31/2024", "Sep 5, 2025", "2025-04-01", "x", None, "16/05/2025 18:52:00", "5 September 2025"]
    assert column(spark, forms, D.form_date) == [date(2025, 9, 5), date(2025, 9, 5), date(2024, 12, 31), None, date(2025, 9, 5), date(2025, 4, 1), None, None, date(2025, 5, 16), date(2025, 9, 5)]
    assert column(spark, ["12/31/2024", "1-4-25", "03/04/2025", "2025-04-01"], D.bank_date) == [date(2024, 12, 31), date(2025, 4, 1), date(2025, 4, 3), None]


def test_fiscal_calendar(spark):
    days = [date(2025, 3, 31), date(2025, 4, 1), date(2099, 12, 1), None]
    assert column(spark, days, D.fiscal_year, "date") == ["2024-25", "2025-26", "2099-00", "Unknown"]
    assert column(spark, days, D.fiscal_index, "date") == [12, 1, 9, 0]
    assert column(spark, ["April", "march", "Jun"], lambda c: D.period_year(c, F.lit("2025-26"))) == ["Apr-25", "Mar-26", "Jun-25"]
    assert column(spark, ["Apr-25", "Apr 2025", "April"], D.iso_month) == ["2025-04", "2025-04", None]
    assert column(spark, ["wage JUL-2025", "Julx 25"], D.month_and_year) == [date(2025, 7, 1), None]


def test_deduction_month(spark):
    df = spark.createDataFrame([(1, date(2025, 4, 30), 0.0, 2024), (2, date(2025, 6, 7), 0.0, 2025), (3, date(2025, 6, 8), 0.0, 2025), (4, date(2025, 6, 8), 5.0, 2025), (5, date(2025, 7, 20), 9.0, 2024)], "i int, d date, x double, y int")
    m, g = D.deduction_month(F.col("d"), F.col("x"), F.col("y"))
    got = [tuple(r) for r in df.select("i", m.alias("m"), g.alias("g")).orderBy("i").select("m", "g").collect()]
    assert got == [(date(2025, 3, 1), False), (date(2025, 5, 1), False), (date(2025, 6, 1), False), (date(2025, 5, 1), False), (date(2025, 3, 1), True)]


def test_headers(spark):
    df = spark.createDataFrame([(["a", "", "a", None, " A\n b"],)], "c array<string>")
    assert df.select(T.unique_headers(F.col("c"))).first()[0] == ["a", "Col", "a_2", "Col_2", "A b"]
    from quillbook.rules.banks import HEADERS

    assert column(spark, ["Tran Date", "Withdrawals (Rs)", "Value Date", "odd"], lambda c: T.canonical_header(c, HEADERS)) == ["date", "debit", "value date", "odd"]


def test_flags_and_missing(spark):
    assert column(spark, ["a; b;a", "", None], lambda c: T.distinct_flags(T.split_flags(c))) == ["a; b", "", ""]
    assert column(spark, ["Unknown", "", None, " NaT ", "x"], T.is_missing) == [True, True, True, True, False]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(-(10**12), 10**12), min_size=1, max_size=20))
def test_indian_grouping_reads_back(spark, values):
    assert column(spark, [float(v) for v in values], lambda c: N.to_float(N.format_indian(c)), "double") == [float(v) for v in values]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.dates(date(2000, 1, 1), date(2099, 12, 31)), min_size=1, max_size=20))
def test_month_labels_read_back(spark, days):
    assert column(spark, days, lambda c: D.label_date(D.month_label(c)), "date") == [d.replace(day=1) for d in days]
