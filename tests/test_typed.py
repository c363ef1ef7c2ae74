"""Hand-written strings: one per pattern and one per rejection rule."""

import datetime as dt

from pyspark.sql import functions as F

from clauseloom.functions import parties as P
from clauseloom.functions import responses as R
from clauseloom.functions import text as X
from clauseloom.functions import typed as T


def values(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["v"] for r in rows.select("i", column(F.col("text")).alias("v")).orderBy("i").collect()]


def test_dates(spark):
    cases = {
        "on 2020-02-29 here": dt.date(2020, 2, 29),
        "on 2/3/2021": dt.date(2021, 2, 3),
        "January 5, 2005": dt.date(2005, 1, 5),
        "the 5th day of March 2019": dt.date(2019, 3, 5),
        "February 31, 2001": None,
        "Section 12, 2005 and then January 5, 2005": None,  # the first match is no month
        "2021-13-01 or March 4, 2020": dt.date(2020, 3, 4),
    }
    got = values(spark, list(cases), lambda t: T.date_of(t)["dt"])
    assert got == list(cases.values())


def test_money(spark):
    cases = {
        "$20MM": (2e7, "USD"), "$5 million": (5e6, "USD"), "USD 1,500.50": (1500.5, "USD"), "2,000 dollars": (2000.0, "USD"),
        "£7": (7.0, "GBP"), "$5,000 by noon": (5000.0, "USD"), "€12": (12.0, "EUR"), "7 billion in all": (7e9, "USD"), "no amount": None,
    }
    got = values(spark, list(cases), T.money_of)
    assert [None if g is None else (g["amount"], g["currency"]) for g in got] == list(cases.values())


def test_money_is_not_read_from_tokens_and_noise(spark):
    cases = {
        'token = "4fe5949719b6b82bc439e9329b" here': None, "token 740d10cfb38a379bfbce847f43f32482d573DC8M": None,
        "onorea$$$ 170.116.163.254### thhe***": None, "del&&& adoas$$$ 4443578346646849$$$ un%%%": None,
        "€€ 5 and ££ 6": None, "token 99aa12b, then $3 million": (3e6, "USD"),
        "(5 million)": (5e6, "USD"), "US$5 B": (5e9, "USD"), "up to-7 billion": (7e9, "USD"),
    }
    got = values(spark, list(cases), T.money_of)
    assert [None if g is None else (g["amount"], g["currency"]) for g in got] == list(cases.values())


def test_durations(spark):
    cases = {
        "ten (10) years": (10, "Years"), "30 days": (30, "Days"), "30 calendar days": (30, "Days"), "five weeks": (5, "Weeks"),
        "a 12-month term": (12, "Months"), "one day": (1, "Days"), "soon": None,
    }
    got = values(spark, list(cases), T.duration_of)
    assert [None if g is None else (g["amount"], g["unit"]) for g in got] == list(cases.values())


def test_numbers(spark):
    cases = {
        "15% of it": 0.15, "15 percent of it": 0.15, "15 per cent of it": 0.15, "see Section 15% now": None,
        "Section 4 is elsewhere; the share that they owe is 7% here": 0.07,
    }
    assert values(spark, list(cases), lambda t: T.percent_of(t)["value"]) == list(cases.values())
    ints = {"up to 30 units": 30.0, "see section 4 for 30 units": None, "exactly 5.": None, "$5 for 7": None, "part 9 units": None,
            "1234567 then 12 units": 12.0}
    assert values(spark, list(ints), lambda t: T.integer_of(t)["value"]) == list(ints.values())


def test_polarity(spark):
    cases = {"shall not exceed ten": False, "must pay": True, "limited to ten": True, "a quiet text": None, "cannot exceed": False}
    assert values(spark, list(cases), T.polarity_of) == list(cases.values())


def test_parties(spark):
    cases = {
        "made by and between Acme Trading and Zenith Corporation WHEREAS both agree": ["Zenith Corporation"],
        "made by and between Acme Inc. and Beta Corporation WHEREAS both agree": ["Acme Inc"],  # "a corporation" is excluded
        "nothing to see in disco": None,
        'Signed "Gamma Holdings Limited" today': ["Gamma Holdings Limited"],
    }
    got = values(spark, list(cases), P.parties_of)
    assert got == list(cases.values())


def test_co_after_a_full_stop_is_no_company(spark):
    cases = {"para el y. Osga as. Una de. Co. Miadora garrrr.": None, "paid to Acme Trading Co. as agreed": ["Acme Trading Co"]}
    assert values(spark, list(cases), P.parties_of) == list(cases.values())


def test_text(spark):
    assert values(spark, ["No.", "N/A", "nothing", "..", ""], X.is_non_answer) == [True, True, False, True, True]
    assert values(spark, ["A_b_c", "A_b", "A"], X.base_contract_id) == ["A", "A_b", "A"]
    assert values(spark, ["one  two three", "one"], lambda t: X.truncate_words(t, 2)) == ["one two", "one"]


def test_number_words():
    assert R.words_to_number("two million five hundred thousand") == 2500000.0
    assert R.words_to_number("forty-two") == 42.0
    assert R.words_to_number("some of it") is None
