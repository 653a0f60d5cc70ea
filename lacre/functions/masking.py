"""Partial masking of CPF numbers: the first three and last two of the eleven digits are hidden."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places of the hidden digits among the eleven.
HIDDEN = (0, 1, 2, 9, 10)


def _eleven(value: Column, then: Column) -> Column:
    digits = F.length(F.regexp_replace(value, r"\P{Nd}", ""))
    return F.when(value.isNull(), F.lit(None)).when(digits == 11, then).otherwise(F.raise_error(F.concat(F.lit("a CPF has 11 digits, not "), digits.cast("string"))))


def mask_cpf(value: Column) -> Column:
    """``***.456.789-**``; an error unless there are eleven digits, null for null."""
    d = F.regexp_replace(value, r"\P{Nd}", "")
    return _eleven(value, F.concat(F.lit("***."), F.substring(d, 4, 3), F.lit("."), F.substring(d, 7, 3), F.lit("-**")))


def hidden_places(value: Column) -> Column:
    """Offsets of the hidden digits in the value as written, ascending."""
    places = F.filter(F.sequence(F.lit(0), F.length(value) - 1), lambda i: F.substring(value, i + 1, F.lit(1)).rlike(r"\p{Nd}"))
    return _eleven(value, F.array(*(F.get(places, F.lit(i)) for i in HIDDEN)))
