"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    """value to so many digits: of the two nearest decimals the nearer one, of equally near ones the even one.

    What counts are the doubles themselves: the decimal below and the one above as doubles, and their distances to the
    value as doubles. Rounding the exact decimal expansion, or value * 10**digits, differs in the last digit of some rates.
    """
    power = float(10**digits)
    scaled = value * power
    below, above = F.floor(scaled).cast("double"), F.ceil(scaled).cast("double")
    down, up = value - below / power, above / power - value
    low = (down < up) | ((down == up) & (F.pmod(below, F.lit(2.0)) == 0))
    # A value of 15 digits or more in all has no room for another.
    fits = F.abs(scaled) < 1e15
    return F.when(value.isNull() | ~fits, value).when(low, below / power).otherwise(above / power)


def rate(part: Column, whole: Column, digits: int = 3) -> Column:
    """part / whole rounded, NULL where whole is zero."""
    return rounded(F.try_divide(part, whole).cast("double"), digits)


def percent(share: Column, digits: int = 2) -> Column:
    """A share as a rounded percentage."""
    return rounded(share * 100, digits)


def _blank(text: Column) -> Column:
    return text.isNull() | (text == "")


def _refused(text: Column, wanted: str, place: Column) -> Column:
    return F.raise_error(F.concat(F.lit("'"), text, F.lit(f"' is no {wanted}"), place))


def whole_count(value: Column, place: Column | None = None) -> Column:
    """A count read from a sheet as text or double. Blank cells stay NULL, what is no whole number is refused."""
    place = F.lit("") if place is None else place
    text, number = F.trim(value.cast("string")), value.try_cast("double")
    whole = (number == F.floor(number)) & (F.abs(number) <= 2.0**53)
    other = (
        F.when(_blank(text), F.lit(None).cast("long"))
        .when(whole, number.cast("long"))
        .otherwise(_refused(text, "whole number", place))
    )
    # Straight to long where it is one: a double keeps whole numbers up to 2**53 only, and most cells end here.
    return F.coalesce(value.cast("string").try_cast("long"), other)


def any_count(value: Column, place: Column | None = None) -> Column:
    """A count or share read as text or number, as a double. Blank cells stay NULL, what is no number is refused."""
    place = F.lit("") if place is None else place
    text, number = F.trim(value.cast("string")), value.try_cast("double")
    return (
        F.when(F.abs(number) < float("inf"), number)
        .when(_blank(text), F.lit(None).cast("double"))
        .otherwise(_refused(text, "number", place))
    )


def checked_counts(values: Column, titles: Column, row: Column, reads_type: str) -> Column:
    """The cells of a row as an array of longs or doubles.

    A cell that is refused is named with its value, its column's place and title, and its row. ``titles`` are
    as many as the values.
    """
    parse = {"long": whole_count, "double": any_count}[reads_type]
    said = (" in sample column ", " '", "' of row ")

    def place(i: Column) -> Column:
        return F.concat(F.lit(said[0]), (i + 1).cast("string"), F.lit(said[1]), F.get(titles, i), F.lit(said[2]), row)

    return F.transform(values, lambda cell, i: parse(cell, place(i)))


def whole_id(value: Column) -> Column:
    """A whole-number id read as text or number, without passing through a double."""
    return F.regexp_replace(value.cast("string"), r"\.0+$", "").cast("long")


def status_code(value: Column) -> Column:
    """A health code as '0' or '1', with '-' for a missing one. Any other code is refused by name."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")  # a code read as 1.0 shows as 1
    missing = text.isNull() | text.isin("", "-")
    unknown = F.raise_error(F.concat(F.lit("unknown status code: "), text))
    return F.when(missing, "-").when(number == 0, "0").when(number == 1, "1").otherwise(unknown)
