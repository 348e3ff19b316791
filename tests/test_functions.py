from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from taxaloom import model
from taxaloom.functions import numbers, text
from taxaloom.functions.sizing import broadcast_if_small, measured_bytes


def evaluate(spark, expression, *values):
    schema = "x string" if not values or isinstance(values[0], (str, type(None))) else "x double"
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in frame.orderBy("i").select(expression).collect()]


@pytest.mark.parametrize(
    "rules, raw, cleaned",
    [
        (model.OWN_NAME_RULES, "100  (07.11)", "100(07.11)"),
        (model.OWN_NAME_RULES, " Ex con 1 ", "ex_con_1"),
        (model.OWN_NAME_RULES, "a con b", "a_con_b"),
        (model.OWN_NAME_RULES, "3t v", "3tv"),
        (model.OWN_NAME_RULES, "100_(07.11)", "100_(07.11)"),
        (model.SHEET_NAME_RULES, "100_(07.11)", "100(07.11)"),
        (model.SHEET_NAME_RULES, "100 (07.11)", "100(07.11)"),
        (model.SHEET_NAME_RULES, "\tN1.H \n", "n1.h"),
        (model.SHEET_NAME_RULES, None, None),
    ],
)
def test_clean_name(spark, rules, raw, cleaned):
    assert evaluate(spark, text.clean_name(F.col("x"), rules), raw) == [cleaned]


def test_taxon_words(spark):
    headers = ["Millepora alcicornis X", "Uncultured", "Two words", "", None]
    assert evaluate(spark, text.genus(F.col("x")), *headers) == ["Millepora", "Uncultured", "Two", "", None]
    assert evaluate(spark, text.species(F.col("x")), *headers) == [
        "Millepora alcicornis",
        None,
        "Two words",
        None,
        None,
    ]


def test_suffix_and_labels(spark):
    assert evaluate(spark, text.without_suffix(F.col("x"), 2), "2.4.h", "ab", "a", "") == ["2.4", "", "", ""]
    assert evaluate(spark, text.label(F.col("x"), model.STATUS_LABELS), "1", "0", "-", "?", None) == [
        "sick",
        "healthy",
        "not assigned",
        None,
        None,
    ]
    assert evaluate(spark, text.contains_any(F.col("x"), model.CONTROL_MARKS), "pcr_neg_1", "ex_con_2", "n1.h") == [
        True,
        True,
        False,
    ]


def test_joined_fields_shows_missing_values(spark):
    fields = text.joined_fields([F.lit(7), F.col("x"), F.lit(12)], " | ")
    assert evaluate(spark, fields, None, "a") == ["7 | NA | 12", "7 | a | 12"]


def test_status_code(spark):
    assert evaluate(spark, numbers.status_code(F.col("x")), "1", "0", "1.0", None, "-", "") == [
        "1",
        "0",
        "1",
        "-",
        "-",
        "-",
    ]


def test_whole_count(spark):
    assert evaluate(spark, numbers.whole_count(F.col("x")), "12", "12.0", "100000", None) == [12, 12, 100000, None]


def test_rate_rounds_ties_to_even(spark):
    pairs = [(k, n) for n in range(1, 41) for k in range(n + 1)]
    frame = spark.createDataFrame(pairs, "k int, n int").select("k", "n", numbers.rate(F.col("k"), F.col("n")))
    for k, n, got in frame.collect():
        assert got == float(round(Fraction(k, n) * 1000)) / 1000, (k, n)


def nearer_decimal(x, digits):
    """The rule with Python's doubles: of the decimals below and above the nearer one, else the even one."""
    power = 10.0**digits
    below, above = math.floor(x * power), math.ceil(x * power)
    down, up = x - below / power, above / power - x
    return (below if down < up or (down == up and below % 2 == 0) else above) / power


def test_rates_round_to_the_nearer_decimal(spark):
    pairs = [(k, n) for n in range(1, 201) for k in range(n + 1)]
    rate = numbers.rate(F.col("k"), F.col("n")).alias("rate")
    other = F.bround(F.col("k") / F.col("n"), 3).alias("other")
    found = spark.createDataFrame(pairs, "k int, n int").select("k", "n", rate, other).collect()
    assert all(got == nearer_decimal(k / n, 3) for k, n, got, _ in found)
    assert sum(got != other for _, _, got, other in found) == 18


@pytest.mark.parametrize("digits", [0, 2, 3])
def test_rounding_of_any_double(spark, digits):
    draw = random.Random(3)
    values = [0.15, 2.5, 0.5, -0.15, -2.5, 1e300, -0.0, 0.285, 1.005, 123456.785, 5e-324]
    values += [draw.uniform(-100, 100) for _ in range(500)] + [draw.randrange(-4000, 4000) / 8 for _ in range(500)]
    got = evaluate(spark, numbers.rounded(F.col("x"), digits), *values)
    assert got == [x if abs(x) > 1e15 else nearer_decimal(x, digits) for x in values]


@pytest.mark.parametrize(
    "given, shown",
    [
        ("north reef", "North Reef"),
        ("NORTH-EAST st.john", "North-East St.john"),
        ("o'neil's  bay/west (inner)", "O'neil's  Bay/West (Inner)"),
        ("2nd reef, 3.5m", "2nd Reef, 3.5m"),
        ("_lagoon a.b c. d", "_Lagoon A.b C. D"),
        ("éCUEIL\tÎLE", "Écueil\tÎle"),
        ("", ""),
        (" ", " "),
        (None, None),
    ],
)
def test_title_case(spark, given, shown):
    assert evaluate(spark, text.title_case(F.col("x")), given) == [shown]


@pytest.mark.parametrize("bad", ["1.7", "0.4", "x", "NaN", "Infinity", "9007199254740993.5"])
def test_whole_counts_refuse_the_rest(spark, bad):
    with pytest.raises(Exception, match=f"'{bad}' is no whole number"):
        evaluate(spark, numbers.whole_count(F.col("x")), bad)


def test_any_count(spark):
    assert evaluate(spark, numbers.any_count(F.col("x")), "0.25", " 3 ", "", None, "1e-3") == [0.25, 3.0, None, None, 0.001]
    with pytest.raises(Exception, match="'x' is no number"):
        evaluate(spark, numbers.any_count(F.col("x")), "x")


def test_rate_without_samples_is_missing(spark):
    frame = spark.createDataFrame([(0, 0)], "k int, n int")
    assert frame.select(numbers.rate(F.col("k"), F.col("n"))).first()[0] is None


def test_plain_number(spark):
    assert evaluate(spark, text.plain_number(F.col("x")), 12.0, 47.5, 0.07) == ["12", "47.5", "0.07"]


def test_broadcast_only_below_the_bound(spark):
    frame = spark.range(1000).selectExpr("id", "repeat('x', 100) AS name")
    size = measured_bytes(frame)
    assert size >= 100_000
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if_small(frame, size))
    assert not hinted(broadcast_if_small(frame, size - 1))
    assert measured_bytes(frame.limit(0)) == 0
