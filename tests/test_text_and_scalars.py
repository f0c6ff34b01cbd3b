import random
from decimal import Decimal

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import plain_text as plain
from ledgerlink.functions import fuzzy, scalars as fx, textratio as tr

TEXT = st.text(alphabet="AB CD-E1", max_size=18)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=12))
def test_ratios_equal_the_plain_definitions(pairs):
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    for fast, slow in [(tr.indel_ratios, plain.ratio), (tr.partial_ratios, plain.partial), (tr.token_sort_ratios, plain.sort_ratio), (tr.token_set_ratios, plain.set_ratio)]:
        assert all(abs(x - slow(p, q)) < 1e-9 for x, p, q in zip(fast(a, b), a, b))


def test_ratios_of_long_texts():
    r = random.Random(5)
    a = ["".join(r.choice("ABCDE ") for _ in range(r.randint(60, 140))) for _ in range(12)]
    b = ["".join(r.choice("ABCDE ") for _ in range(r.randint(50, 140))) for _ in range(12)]
    for fast, slow in [(tr.indel_ratios, plain.ratio), (tr.partial_ratios, plain.partial), (tr.token_set_ratios, plain.set_ratio)]:
        assert all(abs(x - slow(p, q)) < 1e-9 for x, p, q in zip(fast(a, b), a, b))


def test_fuzzy_columns_and_nulls(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("same", "same"), (None, "x"), (None, None)], "a string, b string")
    got = [r[0] for r in df.select(fuzzy.ratio("a", "b")).collect()]
    assert abs(got[0] - 800 / 13) < 1e-9 and got[1:] == [100.0, 0.0, 100.0]


def test_amount_strings(spark):
    rows = ["₹10,000", "1,00,000", "23600.50", "bad", "", "  50 000  ", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(fx.parse_amount(F.col("s"))).collect()]
    assert got == [Decimal("10000.00"), Decimal("100000.00"), Decimal("23600.50"), None, None, Decimal("50000.00"), None]


def test_date_strings(spark):
    rows = ["15-08-2026", "2026-08-15", "15/08/2026", "15 Aug 2026", "15-Aug-2026", "31-02-2026", "x"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    got = [str(r[0]) for r in df.orderBy("i").select(fx.parse_date(F.col("s"))).collect()]
    assert got == ["2026-08-15"] * 5 + ["None"] * 2


def test_digits_tails_and_clip(spark):
    df = spark.createDataFrame([(Decimal(x),) for x in ("12450.50", "5000.00", "0.08", "-950.25", "0.00")], "a decimal(18,2)")
    assert [r[0] for r in df.select(fx.leading_digit(F.col("a"))).collect()] == [1, 5, 8, 9, None]
    one = spark.range(1).select(fx.chi_square_sf8(F.lit(20.09)).alias("a"), fx.chi_square_sf8(F.lit(15.507)).alias("b"), fx.clip(F.lit(None).cast("double"), 0, 1).alias("c")).first()
    assert round(one.a, 4) == 0.01 and round(one.b, 4) == 0.05 and one.c is None


def test_reply_extraction(spark):
    rows = [
        'Sure ```json\n{"assessment": "match", "confidence_delta": 999, "explanation": "ok"}\n``` bye',
        'x {"assessment": "no_match", "confidence_delta": -5, "explanation": "brace } inside"} tail',
        "no json", '{"assessment": "maybe", "confidence_delta": 1}', "{broken", None,
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string").orderBy("i")
    got = [r[0] for r in df.select(fx.parse_reply(F.col("s"))).collect()]
    assert got[0].assessment == "match" and got[0].confidence_delta == 999
    assert got[1].assessment == "no_match" and got[1].explanation == "brace } inside"
    assert got[2:] == [None] * 4


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(fx.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
