"""Text expressions on product names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lacks(text: Column, part: str) -> Column:
    """True where ``part`` does not occur; a missing text is kept.

    The ``OR IS NULL`` form can reach a scan of the table that holds the text. Behind an outer join it
    stays above the join.
    """
    return text.isNull() | ~text.contains(part)


def tokens(text: Column) -> Column:
    """Split on single spaces; doubled spaces give empty tokens."""
    return F.split(text, " ")


def has_digit(text: Column) -> Column:
    return text.rlike(r"\p{Nd}")


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{IsAlphabetic}")


def first_number(text: Column) -> Column:
    """First number in the text as double; grouping commas are ignored, NULL where there is none."""
    found = F.regexp_extract(text, r"(-?[0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def first_word_upper(text: Column) -> Column:
    return F.upper(F.substring_index(text, " ", 1))
