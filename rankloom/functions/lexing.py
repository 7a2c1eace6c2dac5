"""Splitting on Unicode white space, and numbers as a Python reader would take them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it: NBSP and the like included.
SPACE = r"(?U)\s+"
_INT = r"^[+-]?[0-9]+(?:_[0-9]+)*$"
_FLOAT = r"^[+-]?(?:(?:[0-9]+(?:_[0-9]+)*)?\.?[0-9]+(?:_[0-9]+)*|[0-9]+(?:_[0-9]+)*\.)(?:[eE][+-]?[0-9]+)?$"
_SPECIAL = r"(?i)^[+-]?(?:nan|inf|infinity)$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def fields(text: Column) -> Column:
    """Fields between runs of white space; none for a blank text."""
    return F.filter(F.split(text, SPACE), lambda x: x != "")


def safe_int(text: Column) -> Column:
    """The integer that a text spells, else null (a trailing ``d`` or ``.0`` makes it none)."""
    return F.when(text.rlike(_INT), F.regexp_replace(text, "_", "").try_cast("long"))


def safe_float(text: Column) -> Column:
    """The number that a text spells, else null."""
    special = F.lower(F.regexp_replace(text, r"^\+", ""))
    named = F.when(special == "nan", float("nan")).when(special.isin("inf", "infinity"), float("inf")).when(special.isin("-inf", "-infinity"), float("-inf")).otherwise(float("nan"))
    return F.when(text.rlike(_FLOAT), F.regexp_replace(text, "_", "").try_cast("double")).when(text.rlike(_SPECIAL), named)


def joined(parts: Column, first: int, last: int) -> Column:
    """Fields from ``first`` (1-based) up to ``last`` from the end (-1: the last one), joined by single spaces."""
    size = F.size(parts) + last - first + 2
    return F.when(size > 0, F.array_join(F.slice(parts, F.lit(first), F.greatest(size, F.lit(0))), " ")).otherwise("")
