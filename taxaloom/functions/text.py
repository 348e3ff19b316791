"""Text expressions on names and taxon headers. Built-in functions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_name(name: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Lower case, white space trimmed on both ends, then literal replacements in the given order."""
    # trim() would leave tabs and non-breaking spaces in place.
    cleaned = F.regexp_replace(F.lower(name), r"(?U)^\s+|\s+$", "")
    for old, new in rules:
        cleaned = F.replace(cleaned, F.lit(old), F.lit(new))
    return cleaned


def genus(header: Column) -> Column:
    """The first word of a header."""
    return F.substring_index(header, " ", 1)


def species(header: Column) -> Column:
    """The first two words of a header, NULL where there is only one."""
    return F.when(F.instr(header, " ") > 0, F.substring_index(header, " ", 2))


def contains_any(text: Column, marks: Iterable[str]) -> Column:
    """Whether the text contains one of the literal marks."""
    found = F.lit(False)
    for mark in marks:
        found = found | text.contains(mark)
    return found


def without_suffix(text: Column, n: int) -> Column:
    """The text without its last n characters, empty where it is shorter."""
    return F.left(text, F.greatest(F.length(text) - n, F.lit(0)))


def joined_fields(fields: Iterable[Column], separator: str) -> Column:
    """Fields as text with a separator. A missing field shows as NA and is not left out."""
    return F.concat_ws(separator, *[F.coalesce(f.cast("string"), F.lit("NA")) for f in fields])


# Letters, digits and underscores are words, and so are a point or apostrophe between two letters, and a point,
# comma or apostrophe between two digits. Everything else parts words, a hyphen too.
WORDS = (
    r"(?:[\p{L}\p{M}\p{N}_]|(?<=[\p{L}\p{M}])[.'\u2019\u00B7](?=\p{L})|(?<=\p{N})[.,'\u2019](?=\p{N}))+"
    r"|[^\p{L}\p{M}\p{N}_]"
)


def title_case(text: Column) -> Column:
    """Each word with its first letter in upper case and the rest in lower case, by the word breaks of Unicode."""

    def titled(word: Column) -> Column:
        head = F.regexp_extract(word, r"(?s)^_*.", 0)
        return F.concat(F.upper(head), F.lower(F.substring(word, F.length(head) + 1, F.length(word))))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), titled), "")


def label(code: Column, labels: dict[str, str]) -> Column:
    """The label of a code, NULL for an unknown code."""
    chosen = F.lit(None).cast("string")
    for value, text in labels.items():
        chosen = F.when(code == value, text).otherwise(chosen)
    return chosen


def plain_number(value: Column) -> Column:
    """A number as text without a trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")
